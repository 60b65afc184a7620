"""confab.sources"""
