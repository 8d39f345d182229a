"""sievemill.sources"""
