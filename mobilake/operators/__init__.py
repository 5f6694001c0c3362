"""mobilake.operators"""
