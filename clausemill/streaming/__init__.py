"""clausemill.streaming"""
