"""groundspark.operators"""
