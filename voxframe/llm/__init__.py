"""Operators for preparing training text at scale.

Nothing outside this folder imports it; its queries are added by the entry module when the folder is there.
"""
