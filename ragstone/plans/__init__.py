"""ragstone.plans"""
