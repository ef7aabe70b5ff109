"""recordkeep.functions"""
