"""Where the tokenizer library's Unicode tables differ from Python's and the ``regex`` module's, as ranges of code points.

Fixed values: they must equal the library's for right counts; a test compares every code point with the library.
"""

from __future__ import annotations


def _points(ranges: str) -> frozenset[int]:
    ends = [(x.split("-") * 2)[:2] for x in ranges.split()]
    return frozenset(c for a, b in ends for c in range(int(a, 16), int(b, 16) + 1))


#: Letters and numbers of the ``regex`` module that are neither to the library.
NO_LETTERS = _points(
    """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
    10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
    18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
    1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F 11DE0-11DE9 1246F
    12475-1247F 12550-12686 16FF4-16FF6
    """
)
#: Marks (and the second part of one composition) that the library neither reorders nor composes.
NO_MARKS = _points(
    """
    7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50
    10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42
    16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF
    """
)
#: Capital letters that Python does not know as such: first, last, and their small letter's distance.
CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
SMALL = {c: c + by for a, b, by in CAPITALS for c in range(a, b + 1)}
