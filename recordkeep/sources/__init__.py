"""recordkeep.sources"""
