"""sievemill.functions"""
