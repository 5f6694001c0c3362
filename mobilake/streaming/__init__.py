"""mobilake.streaming"""
