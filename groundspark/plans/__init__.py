"""groundspark.plans"""
