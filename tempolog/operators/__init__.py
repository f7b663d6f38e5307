"""tempolog.operators"""
