"""Training-data operators (quality, language model, URLs, near copies, fingerprints, tokens, chat, leaks, repeats, packing).

Nothing outside this subpackage imports it, so that the rest of the library works without it.
"""
