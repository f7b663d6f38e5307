"""tempolog.sources"""
