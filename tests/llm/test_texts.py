"""Operators on texts against brute force, at the edges and on the given tables."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from logevidence.llm import jaccard, suffixes  # noqa: E402
from logevidence.llm.decontaminate import contamination, verdicts  # noqa: E402
from logevidence.llm.jaccard import linked_documents, shingle_sets  # noqa: E402
from logevidence.llm.licence_texts import KNOWN, NOTICES, TEXTS  # noqa: E402
from logevidence.llm.licences import find_licences  # noqa: E402
from logevidence.llm.privacy import digests, private_spans, sanitised  # noqa: E402
from logevidence.llm.suffixes import HashedSuffixes, repeated_spans, repeated_starts  # noqa: E402

SF = "/root/testdata/sf0.001"


def sample(spark, n=120):
    return [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").limit(n).collect()]


def near_copies(seed, groups=6, copies=5, size=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(8, size))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    texts = near_copies(1) + near_copies(2, groups=2, copies=12) + brute.EDGES + ["one two", "ONE  two", "one two three four"]
    found = linked_documents(brute.frame(spark, texts)).collect()
    expected = brute.components(list(enumerate(texts, 1)), 4, 85)
    named = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None}
    assert named == expected
    assert len(found) == len(texts) + 2 and [r["component_id"] for r in found if r["doc_id"] is None] == [None]


def test_links_over_shuffle_instead_of_broadcast(spark):
    texts = near_copies(3)
    found = linked_documents(brute.frame(spark, texts, extra=False), 5, 80, most_sent=0).where("doc_id IS NOT NULL").distinct().collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute.components(list(enumerate(texts, 1)), 5, 80)


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [(5, "a b c d e"), (5, "p q r s t"), (3, "a b c d e"), (9, "p q r s t"), (10, "z z z z")]
    found = linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").distinct().collect()
    assert {tuple(r) for r in found} == {(5, 3), (3, 3), (9, 3), (10, 10)}


def test_a_null_id_before_its_copies_hides_no_link(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (5, text), (6, text + " w60"), (None, "alone"), (7, "alone")]
    found = linked_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(None, None), (5, 5), (6, 5), (7, 7)}


def test_links_of_an_empty_table(spark):
    assert linked_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingles_of_fewer_words_are_one():
    import pyarrow as pa

    rows, _ = shingle_sets(pa.array(["a b", None, "", "a b c d e", "x x x x x x"]), 4)
    assert np.bincount(rows, minlength=5).tolist() == [1, 0, 0, 2, 1]


def repeat_texts():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passage, line = word(420), word(230)
    texts = [word(150) + passage[i : i + 300] + word(90) for i in range(0, 120, 11)]
    texts += [line, line + "z", word(30) + line, "a" * 199, "a" * 200, "b" * 201, "ab" * 400, word(2000), passage * 3]
    return texts + brute.EDGES


@pytest.mark.parametrize("hot,sent", [(20_000, 500_000), (2, 0)])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, hot, sent):
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts = repeat_texts()
    docs = brute.frame(spark, texts)
    found = repeated_spans(docs, most_sent=sent).drop("removed").collect()
    expected = brute.repeats([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(brute.key, found)) == sorted(map(brute.key, expected))


def test_repeated_strings_of_an_empty_table(spark):
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_sort_and_extensions():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(200)]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts])
    group = np.sort(np.array([r.randrange(9) for _ in texts]))
    s = HashedSuffixes(data, np.cumsum(size) - size, size)
    order = s.sort(group)
    assert order.tolist() == sorted(range(len(texts)), key=lambda i: (group[i], texts[i], i))
    common = s.neighbours(order, group)
    for at in range(1, len(order)):
        i, j = order[at - 1], order[at]
        if group[i] == group[j]:
            n = 0
            while n < min(size[i], size[j]) and texts[i][n] == texts[j][n]:
                n += 1
            assert common[at] == n
    assert repeated_starts(np.zeros(1, np.int64), [b"x" * 250], np.array([30]), np.array([20]))[0].tolist() == []


@pytest.mark.parametrize("block", [16 << 20, 400])
def test_contamination_equals_brute_force(spark, block):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, "short item"), (901, "Short, ITEM!"), (902, None), (903, "..."), (904, "é"), (905, items[0][1]), (906, "Ünï çödé")]
    texts = sample(spark) + brute.EDGES + [items[1][1].upper(), "x short item y", "short item", items[2][1] * 2, "ünï ÇÖDÉ"]
    docs = brute.frame(spark, texts)
    bench = spark.createDataFrame([*items, (None, "no id here"), items[3]], "item_id long, text string")
    found = verdicts(contamination(docs, bench, block_bytes=block)).drop("longest_match").collect()
    expected = brute.contaminated([tuple(r) for r in docs.select("doc_id", "text").collect()], items)
    assert sorted(map(brute.key, found)) == sorted(map(brute.key, expected))


def test_longest_match_and_place(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"before it {item} after"), (2, "w3 w4")], "doc_id long, text string")
    rows = contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(i["item"], i["longest"], i["at"]) for i in rows[0]["items"]] == [("7", 30, 2)]
    assert [(h["first"], h["last"]) for h in rows[0]["hits"]] == [(2, 31)] and rows[1]["hits"] == []


def test_contamination_sees_words_whole_and_repeats_in_proportion(spark):
    """Words that a polynomial hash modulo 2^64 confuses, and documents and items of one word, whose pairs of places would multiply."""
    pattern = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
    loop = "again " * 600
    rows = [(1, f"one {other} two"), (2, f"one {pattern} two"), (3, "again " * 300_000), (4, "x " + "again " * 20 + "y " + "again " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("p", pattern), ("l", loop)], "item_id string, text string")
    found = {r["doc_id"]: r for r in contamination(docs, bench).collect()}
    assert [len(found[i]["hits"]) for i in (1, 2, 3, 4)] == [0, 1, 1, 2]
    assert [(x["item"], x["longest"], x["at"]) for x in found[3]["items"]] == [("l", 600, 0)]
    assert [(x["item"], x["longest"], x["at"]) for x in found[4]["items"]] == [("l", 40, 22)]
    assert shingle_sets(pa.array([pattern]), 1)[1] != shingle_sets(pa.array([other]), 1)[1]


def test_longest_matches_equal_brute_force(spark):
    r = random.Random(8)
    make = lambda n, k: [f"v{r.randrange(k)}" for _ in range(n)]
    items = [(str(i), make(r.randint(5, 40), k)) for i, k in enumerate((2, 2, 3, 50, 50, 50))]
    docs = []
    for d in range(12):
        w = make(30, 50)
        for _ in range(3):
            _, item = r.choice(items)
            a = r.randrange(len(item))
            w[r.randrange(len(w)) : 0] = item[a : a + r.randint(4, 25)]
        docs.append((d, w))
    texts = lambda rows: [(i, " ".join(w)) for i, w in rows]
    found = contamination(
        spark.createDataFrame(texts(docs), "doc_id long, text string"), spark.createDataFrame(texts(items), "item_id string, text string"), window=4, block_bytes=200
    ).collect()
    for row in found:
        mine = dict(docs)[row["doc_id"]]
        for item, theirs in items:
            n = max((k for k in range(len(mine) + 1) for a in range(len(mine) - k + 1) for b in range(len(theirs) - k + 1) if mine[a : a + k] == theirs[b : b + k]), default=0)
            got = {x["item"]: x for x in row["items"]}.get(item)
            assert (got["longest"] if got else 0) == (n if n >= min(4, len(theirs)) else 0)
            if got:
                at = mine[got["at"] : got["at"] + n]
                assert any(theirs[b : b + n] == at for b in range(len(theirs)))


def test_contamination_without_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert verdicts(contamination(docs, none)).select("n_words", "n_hit", "contaminated").collect() == [(2, 0, False)]
    assert contamination(docs.limit(0), none).collect() == []


PRIVATE = [
    "mail a.b@c.d%e@f.g x@y é@z.de and A_b+c@d-e.co.uk. end", "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1 1.2.3", "4381-8937-5774-1609 and 4381 8937 5774 1609 12",
    "+49 (30) 1234567 +1 2 +123456789012345678 +4930123456", "𝒳 a@b.co 😀 +4930123456", "1 " * 4000, "4" * 3000, "@" * 300, "a@a." * 800, "4111111111111111@x.y 192.168.0.1",
]


def test_personal_data_equals_brute_force(spark):
    texts = sample(spark) + brute.EDGES + PRIVATE
    docs = brute.frame(spark, texts)
    found = digests(private_spans(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    expected = [(r["doc_id"], *brute.personal(r["text"])) for r in docs.collect()]
    assert sorted(map(brute.key, found)) == sorted(map(brute.key, expected))


def test_terms_that_disclose_are_taken_out(spark):
    told = [f"the {w} butler of Zanzibar writes to bo@x.org the same day" for w in ("good", "old", "late")]
    texts = told + [f"the day is good and the {w} same" for w in ("night", "wind", "rain", "snow", "hail", "mist")] + ["same day", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = private_spans(docs)
    out = [r["text"] for r in sanitised(docs, spans).orderBy("doc_id").collect()]
    assert out[0] == "the good" + " " * 6 + "[EMAIL] the same day" and out[3:] == texts[3:]
    row = spans.where("doc_id = 0").collect()[0]
    assert {told[0][s["start"] : s["end"]] for s in row["removed"]} == {"butler", "of", "Zanzibar", "writes", "to"}


def test_terms_far_off_and_short_and_of_one_document(spark):
    told = [f"Li of R2D2 said 李 ok {'the day is good and ' * 20}mail bo@x.org the {w} day, li, R2D2 and Quixote, bo@x.org" for w in ("hot", "dry", "wet")]
    alone = "the Hermit in Nowhere is at zo@y.org on a good day"
    texts = [*told, alone] + [f"the day is good and {w} said so ok on mail" for w in ("night", "wind", "rain", "snow", "hail", "mist", "Quixote")] * 6 + ["R2D2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = private_spans(docs)
    row = spans.where("doc_id = 0").collect()[0]
    assert [told[0][s["start"] : s["end"]] for s in row["generalised"]] == ["R2D2", "R2D2"]
    assert [told[0][s["start"] : s["end"]] for s in row["removed"]] == ["Li", "of", "李", "li"]
    out = [r["text"] for r in sanitised(docs, spans).orderBy("doc_id").collect()]
    assert "R2D2" not in out[0] and "Quixote" in out[0] and out[4:] == texts[4:]
    assert out[3] == alone.replace("zo@y.org", "[EMAIL]")  # one document is no evidence


def test_disclosing_terms_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünal", "o", "42"]
    people = [("ann@a.org", ["Annika", "7b"]), ("10.1.2.3", ["Gate", "ann"]), ("+49 30 1234567", ["Berta"]), ("4111 1111 1111 1111", ["VISA", "Ünal"])]
    rows = []
    for i in range(160):
        words = [r.choice(vocabulary) for _ in range(r.randint(3, 25))]
        for entity, near in people:
            if r.random() < 0.06:
                words[r.randrange(len(words)) : 0] = [entity, *(w for w in near if r.random() < 0.9)]
        rows.append((i, " ".join(words) + r.choice(["", ".", "\nVISA"])))
    rows += [rows[3], (3, "Annika ann@a.org"), (None, "Annika 7b ann@a.org"), (900, None), (901, "")]
    docs = spark.createDataFrame([(*row, "e", "d", "t", 1.5) for row in rows], "doc_id long, text string, every string, doc string, `th.x` string, share double")
    found = private_spans(docs).collect()
    expected = brute.disclosed(rows)
    th = {(x["doc_id"], x["text"]): x["th"] for x in docs.selectExpr("doc_id", "text", "xxhash64(text) AS th").collect()}
    by_place = {(d, th[d, t]): v for (d, t), v in expected.items()}
    plain = lambda spans: [(s["start"], s["end"]) for s in spans]
    assert len(found) == len(rows)
    for x in found:
        assert (plain(x["generalised"]), plain(x["removed"])) == by_place[x["doc_id"], x["th"]]
    assert sum(len(a) + len(b) for a, b in expected.values()) > 20
    clean = sanitised(docs, private_spans(docs))
    assert clean.columns == docs.columns and clean.count() == len(rows) and {x["every"] for x in clean.collect()} == {"e"}


def test_many_spans_in_a_long_text_cost_no_square(spark):
    many = " ".join(f"word{i % 50} u{i}@host.org 𝒳" for i in range(30_000))
    docs = spark.createDataFrame([(1, many), (2, "word1 u7@host.org"), (3, "word2")], "doc_id long, text string")
    clean = {x["doc_id"]: x["text"] for x in sanitised(docs, private_spans(docs)).collect()}
    assert clean[1] == " ".join(f"word{i % 50} [EMAIL] 𝒳" for i in range(30_000)) and clean[2] == "word1 [EMAIL]"


def test_sanitised_texts_hold_no_base_span(spark):
    docs = brute.frame(spark, sample(spark) + PRIVATE[:5] + brute.EDGES)
    clean = sanitised(docs, private_spans(docs))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    again = digests(private_spans(clean)).selectExpr("sum(n_email)", "sum(n_ip)", "sum(n_phone)").collect()[0]
    assert tuple(again) == (0, 0, 0)


def test_overlapping_spans_are_replaced_whole(spark):
    texts = ["ip 10.0.0.0 4111 1111 1111 1111 end", "a@b.4111 1111 1111 1111 end", "a@b.co.+4930123456 end", "+49 1.2.3.4 567 890 end"]
    docs = brute.frame(spark, [*texts, *PRIVATE])
    spans = private_spans(docs)
    clean = sanitised(docs, spans)
    assert tuple(digests(private_spans(clean)).selectExpr("sum(n_email)", "sum(n_ip)", "sum(n_card)", "sum(n_phone)").collect()[0]) == (0, 0, 0, 0)
    out = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert out[1] == "ip [IP] end" and out[2] == "[EMAIL] end" and not any(c.isdigit() for i in (1, 2, 3, 4) for c in out[i])


def test_privacy_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert digests(private_spans(empty)).collect() == [] and sanitised(empty, private_spans(empty)).collect() == []


def test_licences(spark):
    known = spark.createDataFrame([*NOTICES, ("X", None), ("Y", "...")], "license_id string, text string")
    texts = ["RELEASED  under the mit LICENCE", "Copyright 2020 Someone\nReleased under the MIT License.", "not released under the MIT License.",
             "a\n\tlicensed under CC-BY 4.0 !\nb", "Licensed under the Apache License, Ver. 2.0"]
    found = {tuple(r) for r in find_licences(brute.frame(spark, texts + brute.EDGES), known).collect()}
    assert found == {
        (1, "text", 0, "MIT"), (1, "line", 1, "MIT"), (1, "run", 1, "MIT"), (2, "text", 0, "MIT"), (2, "line", 2, "MIT"), (2, "run", 1, "MIT"),
        (3, "run", 2, "MIT"), (4, "line", 2, "CC-BY-4.0"), (4, "run", 2, "CC-BY-4.0"), (5, "text", 0, "Apache-2.0"), (5, "line", 1, "Apache-2.0"), (5, "run", 1, "Apache-2.0"),
    }
    assert find_licences(brute.frame(spark, texts).limit(0), known).collect() == []


def test_whole_licence_texts_within_other_words_and_wrapped_anew(spark):
    r = random.Random(6)
    texts = []
    for _, text in TEXTS:
        wrapped = "".join(w + r.choice([" ", " ", "\n", "\n   "]) for w in text.replace("License", "Licence").split())
        texts.append(f"Copyright (c) 2021 The Holder\nsome code here {wrapped} and then more")
    known = spark.createDataFrame([*KNOWN, ("one", "Zebra"), ("two", "striped zebra")], "license_id string, text string")
    texts.append("a striped zebra")
    found = find_licences(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string"), known).collect()
    runs = {(x["doc_id"], x["license_id"]) for x in found if x["scope"] == "run"}
    assert {(i, name) for i, (name, _) in enumerate(TEXTS, 1)} | {(len(texts), "one"), (len(texts), "two")} <= runs
    assert [x["line"] for x in found if (x["scope"], x["license_id"]) == ("run", "one")] == [3]
    assert not any(x["scope"] in ("text", "line") for x in found if x["doc_id"] < len(texts))


def test_groups_of_equal_hashes_are_parted_by_their_bytes():
    data = np.frombuffer(b"abcabdabcxyz", np.uint8)
    start = np.array([0, 3, 6, 9])
    same = np.zeros(4, np.uint64)
    order, new = suffixes.checked_groups(data, same, same, start, start + 3)
    groups = [sorted(g.tolist()) for g in np.split(order, np.flatnonzero(new)[1:])]
    assert groups == [[0, 2], [1], [3]]
    order, new = suffixes.checked_groups(data, same[:2], same[:2], start[[0, 2]], start[[0, 2]] + 3)
    assert new.tolist() == [True, False]
    digests = suffixes.digests_of(data, start, start + 3, same)
    assert digests[0] == digests[2] and len(set(digests.tolist())) == 3
