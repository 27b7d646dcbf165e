import re


def folded_words(text):
    """Words of the lower-cased (A-Z) text: runs of 0-9, a-z and non-ASCII."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


#: Tables large enough to learn from.
SF_ACCURACY = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"
