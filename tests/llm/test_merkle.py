"""The Merkle manifest against a plain version of its rules."""

import hashlib
import zlib
from collections import defaultdict

from talkmill.llm import merkle

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, key string, total int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    told = []
    for value in row:
        told.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return digest(*told)


def tree(nodes):
    """The top, and the path of siblings (before, after) of each node."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, above_owners = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for j, held in enumerate(owners[a : a + 8]):
                for i in held:
                    paths[i].append((run[:j], run[j + 1 :]))
            above.append(digest(*run))
            above_owners.append(sum(owners[a : a + 8], []))
        nodes, owners = above, above_owners
    return nodes[0], paths


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, held = [], []
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        top, paths = tree([leaf_of(r) for r in own])
        tops.append(top)
        held.append((own, paths))
    root, above = tree(tops)
    out = []
    for lang_top, path_above, (own, paths) in zip(tops, above, held, strict=True):
        for row, path in zip(own, paths, strict=True):
            path = path + path_above
            altered = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                altered = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            h = leaf_of(altered)
            for before, after in path:
                h = digest(*before, h, *after)
            out.append((row[0], leaf_of(row), lang_top, root, digest(*[x for b, a in path for x in b + a]), h, h == root))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def test_equals_the_plain_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    found = shown(merkle.manifest(docs))
    assert found == plain(rows)
    assert {True, False} == {r[-1] for r in found}


def test_nulls_ties_copies_negative_and_sparse_ids(spark):
    rows = [(i, "s", "en", 3, "Abc") for i in range(0, 3000, 7)]
    rows += [(-(2**63), None, "en", None, None), (2**63 - 1, "s", "en", 1, "x"), (-5, "s", "en", 1, ""), (None, "s", "en", 1, "N"), (None, "s", "en", 1, "N")]
    rows += [(7, "s", None, 2, "Ü"), (7, "s", None, 2, "Ä"), (7, "t", None, None, None)]
    rows += [(12, "copies", "fr", 4, "Same")] * 1300 + [(1, "s", "fr", 4, "One"), (10**12, "s", "fr", 4, "Last")]
    rows += [(i, "s", f"l{i:02}é", 1, "T") for i in range(70)] + [(1, "s", "", 1, "blank language")]
    assert shown(merkle.manifest(made(spark, rows))) == plain(rows)


def test_one_row_and_none(spark):
    rows = [(4, "s", "en", 3, "Abc")]
    found = shown(merkle.manifest(made(spark, rows)))
    assert found == plain(rows)
    assert found[0][1] == found[0][2] == found[0][3] and found[0][4] == digest()
    assert merkle.manifest(made(spark, [])).count() == 0


def test_a_very_long_text(spark):
    rows = [(i, "s", "en", 1, "Wort über Wort " * (200_000 if i == 3 else 1)) for i in range(9)]
    assert shown(merkle.manifest(made(spark, rows))) == plain(rows)


def test_ranks_count_rows_before(spark):
    ids = [*range(-300, 300), *range(10**15, 10**15 + 5000, 3), *[2**62 + i * 2**40 for i in range(50)]]
    rows = [(i, "s", "en" if i % 5 else None, 1, "T") for i in ids]
    found = merkle.ranked(merkle.leaves(made(spark, rows))).select("grp", "doc_id", "first", "total").collect()
    for grp in ("0", "1en"):
        own = sorted(r.doc_id for r in found if r.grp == grp)
        assert {r.doc_id: r.first for r in found if r.grp == grp} == {d: k for k, d in enumerate(own)}
        assert {r.total for r in found if r.grp == grp} == {len(own)}
