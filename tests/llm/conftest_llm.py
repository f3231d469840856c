import re


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")
