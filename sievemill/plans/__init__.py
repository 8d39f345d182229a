"""sievemill.plans"""
