"""recordkeep.streaming"""
