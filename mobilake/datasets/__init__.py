"""mobilake.datasets"""
