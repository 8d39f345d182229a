"""sievemill.streaming"""
