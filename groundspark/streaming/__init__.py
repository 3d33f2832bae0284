"""groundspark.streaming"""
