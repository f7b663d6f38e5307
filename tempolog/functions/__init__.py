"""tempolog.functions"""
