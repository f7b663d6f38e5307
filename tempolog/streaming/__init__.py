"""tempolog.streaming"""
