"""mobilake.functions"""
