import re


def words(text):
    """Words of the contract: runs of anything but white space, A-Z lower-cased."""
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[^\x20\x09-\x0D]+", text or "")]
