"""confab.operators"""
