"""ragstone.functions"""
