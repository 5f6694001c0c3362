"""mobilake.plans"""
