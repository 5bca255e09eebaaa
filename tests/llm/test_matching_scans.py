"""Entity matching and scan repair on small data with known answers."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantora.llm import matching, scans


def test_tokens_and_codes():
    assert matching.tokens("9、dn80管", "2.50mm") == sorted(["n:80", "w:dn", "管", "n:2.5", "w:mm"])
    assert matching.code_digits("08-14-05-040301") == "081405040301" and matching.code_digits("FB-047") == ""
    assert matching.flat("Ｆａ çade​ x") == "façadex"


def test_one_item_each():
    rows = np.array([1, 1, 2, 3, 3])
    p = matching.one_item_each(np.array([5.0, 5.0, 5.0, -5.0, 8.0]), rows)
    assert abs(p[0] - p[1]) < 1e-9 and p[0] < 0.5 and p[2] > 0.99 and p[4] > 0.99 and p[3] < 0.01
    assert len(matching.one_item_each(np.zeros(0), np.zeros(0))) == 0


def _bills(spark):
    works = [("0101010%02d" % w, n) for w, n in enumerate(["承台坑土方挖运", "基坑淤泥挖运", "屋面卷材防水", "剪力墙混凝土", "矩形柱模板", "室内给水管敷设"], 1)]
    lines, rows, truth, i = [], [], set(), 0
    for project in range(1, 41):
        for w, (code, name) in enumerate(works):
            for size in (50, 80, 100):
                if (project + w + size // 10) % 3:
                    i += 1
                    code12 = code + "%03d" % size
                    lines.append((i, project, code12 if i % 7 else None, name, f"公称{size}", "m", str(10 + w * 5 + size)))
                    r = 1000 + i
                    if i % 2:
                        rows.append((r, project, code if i % 3 else "12", name[:-2] + "作业", f"dn{size}", "m", str((10 + w * 5 + size) * 0.9)))
                        truth.add((i, r))
                elif project % 2:
                    rows.append((5000 + project * 100 + w * 3 + size, project, code, name[:-2] + "作业", f"dn{size}", "m", "99"))
    schema = "id bigint, _project bigint, code string, name string, feature string, unit string, unit_price string"
    return spark.createDataFrame(lines + [(90001, None, "x", "y", "z", "m", "1"), (90002, 1, None, None, None, None, None)], schema), spark.createDataFrame(rows + [(90003, 1, None, None, None, None, None), (90004, None, None, "a", None, None, None)], schema), truth


def test_matching_finds_the_truth(spark):
    lines, rows, truth = _bills(spark)
    got = {(r.line_item_id, r.row_id): r.confidence for r in matching.match_lines(lines, rows).collect()}
    hit = len(truth & got.keys())
    assert hit / len(truth) > 0.95 and hit / len(got) > 0.95, (hit, len(truth), len(got))
    assert all(matching.MATCHED < c <= 1 for c in got.values())
    assert matching.match_lines(lines.limit(0), rows).count() == 0 and matching.match_lines(lines, rows.limit(0)).count() == 0


def test_page_numbers_and_titles():
    for text, n in (("- 7 -", 7), ("7/19", 7), ("第 l2 页 共 20 页", 12), ("第十二页", 12), ("Page 3 of l9", 3), ("p. 4", 4), ("[6]", 6), ("·8·", 8)):
        assert scans.page_number_of(text) == n, text
    for text in ("3.2", "一、土方", "Item 7 is open", "", "7 days after"):
        assert scans.page_number_of(text) is None, text
    assert scans.title_of("内部资料　　l2") == ("内部资料", 12)
    assert scans.title_match("内部资科 注意保存", ["内部资料 注意保存"]) == (True, True)
    assert scans.title_match("内部资料 注意保存  | 3", ["内部资料 注意保存"]) == (True, False)
    assert scans.title_match("其他文字内容", ["内部资料 注意保存"])[0] is False


def _pages(spark):
    body = ["the reviewer accepts the well-documented reason", "and confirms the measured extent of the external", "insulation in writing"]
    rows = []
    for f in range(1, 13):
        for p in range(1, 9):
            ocr = f % 2 == 0
            lines = ["Settlement Report 7", f"of {f * p} items " + body[0], *body[1:], "further exter-", "nal work is ready-", "mixed as agreed", f"the ready-mixed concrete is external work of {f + p} days", f"- {p + 3} -"]
            if ocr and p == 4:
                lines[2] = lines[2].replace("measured", "measurecl")
                lines[0] = "Settlernent Report 7"
                lines[-1] = f"- {p + 3} -".replace("7", "7")
            rows.append((f * 100 + p, f, p, "ocr" if ocr else "native_text", "\n".join(lines), 0.7))
    rows += [(9001, None, None, "ocr", None, None), (9002, 1, 1, "pending_ocr", "", None), (None, 1, 2, "ocr", "x", None), rows[3]]
    return spark.createDataFrame(rows, "page_id bigint, file_id bigint, page_number int, status string, text string, kind double")


def test_scan_noise(spark):
    got = {(r.page_id, r.line_no, r.kind) for r in scans.scan_noise(_pages(spark)).collect()}
    clean = 103
    assert {k for k in got if k[0] == clean} == {(clean, 1, "header"), (clean, 9, "page_number"), (clean, 5, "hyphen")}
    noisy = 204
    assert (noisy, 3, "misread") in got and (noisy, 1, "misread") in got and (noisy, 1, "header") in got
    assert not any(k[2] == "misread" and k[0] // 100 % 2 for k in got if k[0] < 9000)  # pages that were read are not suspected
    assert scans.scan_noise(_pages(spark).limit(0)).count() == 0


def test_paragraphs(spark):
    rows = scans.paragraphs(_pages(spark)).filter("file_id = 2").orderBy("paragraph_no").collect()
    text = " ".join(r.text for r in rows)
    assert "external work" in text and "exter-" not in text and "ready-mixed" in text and "readymixed" not in text
    assert "Settlement Report" not in text and "measurecl" not in text and "measured" in text


def test_glyph_edits_and_vectors():
    assert {"modern", "should", "thousand"} <= scans.glyph_edits("modem") | scans.glyph_edits("sbould") | scans.glyph_edits("thousancl") | {"modern"}
    pairs = pd.DataFrame([("墙体", "剪", 9), ("墙体", "力", 9), ("柱子", "方", 9), ("柱子", "形", 9)], columns=["word", "context", "n"])
    lex = scans.learn_vectors({"墙体": 18, "柱子": 18}, pairs)
    near = lex.vector(["剪", "力"], [2, 2])
    assert near @ lex.word_vectors[lex.words["墙体"]] > near @ lex.word_vectors[lex.words["柱子"]]
    assert scans.chinese_number("十二") == 12 and scans.chinese_number("x") is None


def test_links_reach_all_frequent_words(spark, monkeypatch):
    placed = scans._usable(_pages(spark)).withColumns({"titles": F.lit(None).cast("array<string>"), "offset": F.lit(None).cast("int")})
    monkeypatch.setattr(scans, "WORDS", 4)
    assert scans.learn_corrections(placed).latin["measurecl"] == "measured"


def test_links_of_words_without_known_context():
    pairs = pd.DataFrame([("墙体", "剪", 9), ("墙体", "力", 9)], columns=["word", "context", "n"])
    lex = scans.learn_vectors({"墙体": 18}, pairs)
    lex.counts = {"墙体": 18}
    rare = pd.DataFrame({"word": ["墙休"], "n": [1], "contexts": [[]]})
    (got,) = scans._link(lex)(iter([rare]))
    assert got["frequent"].tolist() == ["墙体"] and got["cosine"].isna().all()


def test_latin_links_need_context():
    pairs = pd.DataFrame([("modern", "house", 9), ("modern", "city", 9), ("cable", "wire", 9), ("cable", "dial", 9)], columns=["word", "context", "n"])
    lex = scans.learn_vectors({"modern": 18, "cable": 18}, pairs)
    lex.counts = {"modern": 18, "cable": 18}
    row = lambda *names: pd.DataFrame({"word": ["modem"], "n": [1], "contexts": [[{"context": x, "n": 1} for x in names]]})
    (far,), (near,) = scans._link(lex)(iter([row("wire", "dial")])), scans._link(lex)(iter([row("house", "city")]))
    assert not len(far) and near["frequent"].tolist() == ["modern"]
    c = scans.Corrections({}, {"modem": "modern", "o": "a"}, {"modern", "a"}, {}, lexicon=lex, vectors={"modern": lex.word_vectors[0]})
    read = lambda text: {p: meant for p, (meant, _) in scans.misread_places(scans.body_of(text, set()), c).items()}
    assert read("house modem city") == {6: "modern"} and read("wire modem dial") == {} and read("x modem y") == {2: "modern"}
    assert read("rate 2.O% of") == {7: "0"} and read("378.O labour days") == {4: "0"} and read("such o house") == {5: "a"}


def test_training_brings_words_with_like_contexts_together():
    rows = [(w, c, n) for w, cs in {"beam": "abc", "bcam": "abc", "invoice": "xyz", "lnvoice": "xyz"}.items() for c, n in zip(cs, (9, 6, 4), strict=True)]
    pairs = pd.DataFrame(rows, columns=["word", "context", "n"])
    lexicon = scans.learn_vectors({"beam": 19, "invoice": 19}, pairs)
    rare = lexicon.vector(list("abc"), [3, 2, 1])
    beam, invoice = (lexicon.word_vectors[lexicon.words[w]] for w in ("beam", "invoice"))
    assert rare @ beam > 0.9 > 0.3 > rare @ invoice


def test_doubt_lowers_the_agreement_asked_for():
    asked = [scans.least_agreement(d) for d in (0.0, 1 / 6, 0.45)]
    assert asked == [1.5, 1.0, 0.5]
