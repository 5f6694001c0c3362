"""mobilake.sources"""
