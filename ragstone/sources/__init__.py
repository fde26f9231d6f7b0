"""ragstone.sources"""
