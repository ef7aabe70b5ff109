"""recordkeep.operators"""
