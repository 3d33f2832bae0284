"""groundspark.sources"""
