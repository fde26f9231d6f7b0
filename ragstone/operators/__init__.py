"""ragstone.operators"""
