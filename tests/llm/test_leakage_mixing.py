"""Leakage against brute force, mixing against its constraints."""

import random

import numpy as np

from quantora.llm import leakage, mixing


def _brute(docs, items):
    found = set()
    for d, text in docs:
        flat = leakage.letters_and_digits(text or "")
        for i, t in items:
            item = leakage.letters_and_digits(t or "")
            half = -(-len(item) // 2)
            if item and any(item[o : o + half] in flat for o in range(len(item) - half + 1)):
                found.add((d, i))
    return found


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij承包人计量") for _ in range(rng.randrange(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 30, 90])))) for i in range(40)] + [(40, ""), (41, None), (42, "！？"), (43, "x")]
    docs = []
    for d in range(150):
        parts = [word() for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            text = rng.choice(items[:40])[1]
            share = rng.choice([0.3, 0.48, 0.52, 0.7, 1.0])
            size = int(len(text) * share)
            at = rng.randrange(0, len(text) - size + 1)
            parts.insert(rng.randrange(0, len(parts) + 1), "".join(c + ("\n" if rng.random() < 0.05 else "") for c in text[at : at + size].upper()))
        docs.append((d, " ".join(parts)))
    docs += [(150, None), (151, ""), (152, "．。"), (None, items[5][1]), docs[0]]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, doc_id int")
    rows = leakage.find_leaks(df, it).collect()
    got = {(r.doc_id, r.item_id) for r in rows if r.run_chars * 2 >= r.item_chars}
    assert got == _brute([d for d in docs if d[0] is not None], items)
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    assert leakage.find_leaks(df.limit(0), it).count() == 0 and leakage.find_leaks(df, it.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 50)
    it = spark.createDataFrame([(i, f"passage number {i} {'xyz' * 10}{i * 7919}") for i in range(5)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"before passage number {i} {'xyz' * 10}{i * 7919} after") for i in range(5)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, it).filter("form = 'whole'").collect()}
    assert {(i, i) for i in range(5)} <= got


def test_edited_copies_and_distance():
    assert leakage.edit_distance("kitten", "sitting") == 3 and leakage.edit_distance("", "ab") == 2 and leakage.edit_distance("abc", "abc") == 0
    text = "the quick brown fox jumps over the lazy dog and runs away from forty two angry bears in the dark forest"
    flat = leakage.letters_and_digits(text)
    edited = flat[:20] + "Q" + flat[20:45] + "Z" + flat[46:70] + flat[72:]
    found = leakage.scan_batch(leakage.ItemIndex([(1, flat)]), ["zzz" + edited + "yyy"])
    run, distance = found[0, 0]
    assert run < len(flat) / 2 and 1 - distance / len(flat) >= leakage.EDIT_SIMILARITY


def _nearest(item, text):
    row = [0] * (len(text) + 1)
    for i, ch in enumerate(item, 1):
        old, row = row, [i]
        for j, other in enumerate(text, 1):
            row.append(min(old[j - 1] + (ch != other), old[j] + 1, row[-1] + 1))
    return min(row)


def test_edited_copies_against_brute_force():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrst承包人计量"
    item = lambda size: "".join(rng.choice(letters) for _ in range(size))
    items = [(i, item(size)) for i, size in enumerate([4, 6, 9, 12, 25, 40, 80, 81, 110, 160])] + [(10, "ab" * 30)]
    docs = []
    for n, text in items * 2:
        for rate in (0.05, 0.1, 0.15, 0.2, 0.25):
            copy = list(text)
            for p in rng.sample(range(len(text)), int(rate * len(text))):
                copy[p] = rng.choice([rng.choice(letters), "", copy[p] + rng.choice(letters)])
            docs.append(item(rng.randrange(60)) + "".join(copy) + item(rng.randrange(60)))
    docs += ["", None, items[7][1]]
    index = leakage.ItemIndex(items)
    found = leakage.scan_batch(index, docs)
    edited = 0
    for d, doc in enumerate(docs):
        for n, (_, text) in enumerate(index.items):
            distance = _nearest(text, doc or "")
            assert leakage.nearest_distance(text, doc or "") == distance
            if 1 - distance / len(text) >= leakage.EDIT_SIMILARITY:
                assert found[d, n][1] == distance, (d, n)
                edited += distance > 0 and found[d, n][0] * 2 < len(text)
    assert edited >= 20


def test_no_edited_copy_is_lost():
    rng = random.Random(9)
    letters = "etaoinshrdlucmfw合同计量"
    items = [(size, "".join(rng.choice(letters) for _ in range(size))) for size in (60, 200, 600)]
    docs, planted = [], []
    for n, (size, text) in enumerate(items):
        for rate in (0.03, 0.06, 0.1, 0.19):
            for _ in range(15):
                copy = list(text)
                for p in rng.sample(range(size), int(rate * size)):
                    copy[p] = rng.choice([rng.choice(letters), "", copy[p] + rng.choice(letters)])
                docs.append("".join(rng.choice(letters) for _ in range(rng.randrange(300))) + "".join(copy))
                planted.append((len(docs) - 1, n, int(rate * size)))
    found = leakage.scan_batch(leakage.ItemIndex(items), docs)
    assert all(found[d, n][1] <= edits for d, n, edits in planted)


def test_equal_windows_share_a_bucket():
    rng = random.Random(4)
    for window in (1, 2, 5, 40):
        text = leakage.padded("".join(rng.choice("abc") for _ in range(300)), window)
        starts = np.arange(300 - window)
        keys = leakage.buckets(text, starts, window)
        of = {}
        for p, key in zip(starts, keys, strict=True):
            of.setdefault(tuple(text[p : p + window]), set()).add(key)
        assert all(len(v) == 1 for v in of.values())


def test_pieces_keep_the_tokens(monkeypatch):
    tokenizer = mixing.encoding(mixing.TOKENIZER_FOLDER, mixing.VOCABULARY)
    rng = random.Random(3)
    signs = "ab 'sté  \n\t12.,;-中文字，。（）  I'm we'll don't"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for size in (1, 3, 7):
        monkeypatch.setattr(mixing, "PIECE", size)
        for text in texts:
            parts = list(mixing.pieces(text))
            assert "".join(parts) == text
            assert sum(len(tokenizer.encode_ordinary(p)) for p in parts) == len(tokenizer.encode_ordinary(text))


def _documents(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "A ", "b", "c", None, "other"]), " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(0, 60)))) for i in range(600)]
    rows += [rows[0], (None, "a", "x y"), (601, "a", None), (602, "b", "")]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, source string, text string, rate double")


def test_mix_meets_its_targets(spark):
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.3, 4), ("none", 0.0, 2)], "source string, target_share double, max_repeat int")
    docs = _documents(spark)
    drawn, report = mixing.mix(docs, targets)
    rows = drawn.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.n_tokens > 0 for r in rows)
    caps = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r.copies <= caps[r.source] for r in rows)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"a", "b", "c"}
    for s, r in got.items():
        assert abs(r.share - r.target_share) < 0.02, r
        assert r.n_tokens == sum(x.copies * x.n_tokens for x in rows if x.source == s)
    assert any(r.at_cap for r in got.values())
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    small = mixing.mix(docs, targets, total_tokens=3000)[1].collect()
    assert abs(sum(r.n_tokens for r in small) - 3000) < 300


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 0.4, 1), ("z", 0.6, 1)], "source string, target_share double, max_repeat int")
    drawn, report = mixing.mix(_documents(spark).limit(0), targets)
    assert drawn.count() == 0
    drawn, report = mixing.mix(_documents(spark).filter("source = 'a'"), targets)
    got = {r.source: r for r in report.collect()}
    assert got["a"].share == 1.0 and got["z"].share == 0.0 and got["z"].n_documents == 0
    assert mixing.mix(_documents(spark), targets.limit(0))[0].count() == 0
