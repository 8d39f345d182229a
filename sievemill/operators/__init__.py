"""sievemill.operators"""
