"""groundspark.functions"""
