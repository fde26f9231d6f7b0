"""ragstone.streaming"""
