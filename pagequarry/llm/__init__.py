"""Training-data operators: sharding, quality, dedup, secrets, mixing, HTML, tokens, language, decontamination.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library intact.
"""
