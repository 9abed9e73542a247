"""Small inputs with results that were worked out by hand or by brute force."""

T10 = ["1 2 3", "1 2", "2 3 4", "1 2 3 4", "3", "1 3", "2 4", "1 2 3 6", "", "6 2"]

# The supports of five items of a public click-stream data set, as lines of an itemset list.
K5 = """
6 (601374)
3 (450031)
11 (364065)
1 (197522)
218 (88598)
3 6 (265180)
6 11 (324013)
1 6 (132113)
6 218 (77675)
3 11 (161286)
1 3 (84660)
3 218 (38673)
1 11 (91882)
11 218 (61656)
1 218 (32127)
3 6 11 (143682)
1 3 6 (57802)
3 6 218 (33978)
1 6 11 (86092)
6 11 218 (60630)
1 6 218 (30182)
1 3 11 (40268)
3 11 218 (26973)
1 11 218 (25790)
1 3 218 (13928)
1 3 6 11 (37743)
3 6 11 218 (26501)
1 6 11 218 (25608)
1 3 11 218 (11176)
1 3 6 218 (13060)
1 3 6 11 218 (11091)
""".strip().splitlines()
