"""The operators that are native expressions: licences, revisits, line rules, chat windows."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat, licenses, linerules, revisits

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---------------------------------------------------------------- line rules


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "one two three four five",
    "a b c d e a b c d e f",
    "w " * 40,
    "Good line here.\nGood line here.\n\n  \nAnother line that is long enough to stay",
    "Home | About | Contact | Login\nA fine sentence that says something, with enough words to count here.",
    "x$$$ y### z&&& q%%% r*** s$$$ t### u&&& v%%% w***",
    "STOP!! SHOUTING!! AT!! ME!! NOW!! PLEASE!! OR!! ELSE!! I!! LEAVE!!",
    "é à ü 😀 ok fine words here now go on.\x0bvertical tab",
    "the same five words again " * 400,
]


def test_line_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], DOCS)
    got = {r["doc_id"]: r for r in rows(linerules.clean_lines(docs))}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(t), t
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_line_verdicts(spark):
    prose = "This is a plain sentence with enough words in it to be kept.\n" + "Another plain sentence follows and says a little more about it."
    docs = spark.createDataFrame([(1, prose, None, None, None), (2, TEXTS[9], None, None, None), (3, TEXTS[10], None, None, None), (4, TEXTS[8] + "\n" + prose, None, None, None)], DOCS)
    got = {r["doc_id"]: r for r in rows(linerules.clean_lines(docs))}
    assert got[1]["kept"] and got[1]["clean_text"] == prose and got[1]["n_lines_removed"] == 0
    assert not got[2]["kept"] and not got[3]["kept"]
    assert got[4]["kept"] and got[4]["n_lines_removed"] == 1 and "Home" not in got[4]["clean_text"]


def test_boilerplate_of_several_languages_and_own_phrases(spark):
    prose = "This is a plain sentence with enough words in it to be kept.\nAnother plain sentence follows and says a little more about it."
    furniture = ["Todos los derechos reservados por la casa de al lado.", "Mit dem Klick auf Cookies akzeptieren stimmen Sie dem zu.", "Ici, la politique de confidentialité de tout ce site.", "Buy (now) at the corner shop, dear reader."]
    docs = spark.createDataFrame([(i, f"{line}\n{prose}", None, None, None) for i, line in enumerate(furniture)], DOCS)
    got = {r["doc_id"]: r["n_lines_removed"] for r in rows(linerules.clean_lines(docs))}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0}
    own = {r["doc_id"]: r["n_lines_removed"] for r in rows(linerules.clean_lines(docs, rules=linerules.LineRules(phrases=("buy (now)",))))}
    assert own == {0: 0, 1: 0, 2: 0, 3: 1}


def test_a_very_long_text(spark):
    long = "\n".join(f"Line {i} of a long text that goes on with some words." for i in range(20000))
    (r,) = rows(linerules.clean_lines(spark.createDataFrame([(1, long, None, None, None)], DOCS)))
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(long)


def test_line_rules_edge_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert linerules.clean_lines(empty).count() == 0
    clash = spark.createDataFrame([(1, "some words.", 5, "x"), (1, "some words.", 5, "x"), (None, None, None, None)], "doc_id long, text string, n_words int, w string")
    got = rows(linerules.clean_lines(clash))
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in got) == [(0, 0), (1, 2), (1, 2)]


# ---------------------------------------------------------------- chat windows

TURNS = "conv_id long, turn long, role string, text string"


def digest(turns):
    body = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def conversations():
    hostile = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST]", "<s>", "a\\b\nc", "[INST", "<<s>>", "", "😀" * 30]
    out = {1: [("user", "hi"), ("assistant", "hello")], 2: [("system", "be brief"), ("user", "x" * 400), ("assistant", "y" * 900), ("user", "z" * 300), ("assistant", "w" * 1200)]}
    out[3] = [("system", "only")]
    out[4] = [(r, t) for t in hostile for r in ("user", "assistant")]
    out[5] = [("user", None), (None, "who"), ("odd\\role\nname", "x"), ("assistant", "done")]
    out[6] = [("user" if i % 2 == 0 else "assistant", f"turn {i} " + "t" * (i % 50)) for i in range(400)]
    out[7] = [("assistant", "v" * 9000)]
    out[8] = [("system", "rules")] + [("user" if i % 2 == 0 else "assistant", f"say {i}") for i in range(300)]
    return out


def test_chat_round_trip_and_budget(spark):
    convs = conversations()
    data = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    windows = chat.format_windows(spark.createDataFrame(data, TURNS), budget=300, history=80).cache()
    got = {r["conv_id"]: r for r in rows(chat.read_back(windows))}
    for c, turns in convs.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(turns), c
    for w in rows(windows):
        new = w["n_turns"] - w["n_repeated"]
        assert w["n_tokens"] <= 300 or new == 1
        assert w["text"].count("<s>") == w["n_turns"] == w["text"].count("</s>")
        for span in w["loss"]:
            assert w["text"][: span["start"]].endswith("<s>assistant\n") and w["text"][span["end"] :].startswith("</s>")
    heads = [w for w in rows(windows) if w["conv_id"] == 2]
    assert len(heads) > 1 and all(w["text"].startswith("<s>system\nbe brief</s>") for w in heads)
    assert any(w["n_repeated"] > 1 for w in rows(windows) if w["conv_id"] == 6)
    long = [w for w in rows(windows) if w["conv_id"] == 8]
    assert len({w["block"] for w in long}) == 5 and all(w["text"].startswith("<s>system\nrules</s>") for w in long)
    assert sum(w["n_turns"] - w["n_repeated"] for w in long) == 301


def slow_windows(turns, budget, history):
    """Repeated and fresh turns of every window, by hand."""
    size = [-(-len(f"<s>{r}\n{t}</s>") // 4) for r, t in turns]
    head = size[0] if turns[0][0] == "system" else 0
    at, out = (1 if head else 0), []
    while at < len(turns):
        end, back = at + 1, at
        while end < len(turns) and sum(size[at : end + 1]) <= budget - history - head:
            end += 1
        while back > (1 if head else 0) and sum(size[back - 1 : at]) <= history:
            back -= 1
        out.append((bool(head and out) + at - back, bool(head) + end - back))
        at = end
    return out


def test_chat_windows_of_long_and_sparse_conversations(spark):
    """Only budgets cut: neither turn numbers nor the count of turns do."""
    turns = [("system", "rules")] + [("user" if i % 2 == 0 else "assistant", f"say {i} " + "t" * (i % 7)) for i in range(700)]
    data = [(c, i * step, r, t) for c, step in ((1, 1), (2, 100), (3, 0)) for i, (r, t) in enumerate(turns if c < 3 else [("user", "same")] * 300)]
    data += [(4, i, "user", "") for i in range(400)]
    got = {}
    for w in rows(chat.format_windows(spark.createDataFrame(data, TURNS))):
        got.setdefault(w["conv_id"], []).append((w["span"], w["n_repeated"], w["n_turns"], w["text"]))
    for c, expected in ((1, turns), (2, turns), (3, [("user", "same")] * 300), (4, [("user", "")] * 400)):
        assert [w[1:3] for w in sorted(got[c])] == slow_windows(expected, 1024, 256), c
    assert [w[3] for w in sorted(got[1])] == [w[3] for w in sorted(got[2])]


def test_chat_edge_tables(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], TURNS))).count() == 0
    data = [(None, None, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b")]
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_windows(spark.createDataFrame(data, TURNS).withColumn("all", F.lit(1)).withColumn("fmt", F.lit("x")))))}
    assert got[None]["turns_sha256"] == digest([("user", "a"), ("assistant", "b")])[1]
    assert got[1]["turns_sha256"] == digest([("assistant", "b"), ("user", "a"), ("user", "a")])[1]


# ---------------------------------------------------------------- revisits

RECORDS = "record_id long, url string, at timestamp, kind string, headers map<string,string>"


def stamp(n):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(minutes=n)


def test_canonical_url(spark):
    urls = ["HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2", "example.com/a/?ref=1&a=1&b=2", "", None, "http://m.x.org"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(revisits.canonical_url(F.col("u")).alias("c"))
    assert [r.c for r in df.collect()] == ["example.com/a?a=1&b=2"] * 3 + [None, None, "x.org"]


def test_revisits_take_the_latest_earlier_response(spark):
    a, b = {"ETag": '"1"', "Content-Length": "9", "X": "old"}, {"etag": '"2"', "Last-Modified": "then"}
    data = [
        (1, "http://h/a", stamp(0), "response", a),
        (2, "http://h/a", stamp(5000), "response", b),
        (3, "http://h/a/", stamp(5), "revisit", {"ETag": 'W/"1"', "Content-Length": "0", "x": "new"}),
        (4, "http://h/a#z", stamp(4000), "revisit", {"etag": '"1"'}),
        (5, "http://h/a", stamp(9000), "revisit", {"etag": '"1"'}),
        (6, "http://h/a", stamp(9001), "revisit", {"last-modified": "then"}),
        (7, "http://h/a", stamp(0), "revisit", {"etag": '"1"'}),
        (8, "http://h/b", stamp(1), "revisit", {"etag": '"1"'}),
        (9, None, stamp(1), "revisit", None),
        (10, "http://h/a", None, "revisit", {"etag": '"1"'}),
        (11, "http://h/a", stamp(4500), "response", {"ETag": '"p"', "Content-Range": "bytes 0-1/9"}),
        (12, "http://h/a", stamp(4600), "revisit", {"etag": '"1"'}),
        (13, "http://h/a", stamp(9002), "revisit", {}),
        (3, "http://h/a/", stamp(5), "revisit", {"ETag": 'W/"1"', "Content-Length": "0", "x": "new"}),
    ]
    got = rows(revisits.resolve_revisits(spark.createDataFrame(data, RECORDS).withColumn("bucket", F.lit("clash")).withColumn("near", F.lit(1))))
    by = {r["record_id"]: r for r in got}
    assert len(got) == 11
    assert {k: (r["status"], r["base_id"]) for k, r in by.items()} == {
        3: ("resolved", 1), 4: ("resolved", 1), 5: ("mismatch", 2), 6: ("resolved", 2), 7: ("no_base", None), 8: ("no_base", None),
        9: ("no_url", None), 10: ("no_base", None), 12: ("resolved", 1), 13: ("unchecked", 2),
    }
    assert by[3]["merged"] == {"etag": 'W/"1"', "content-length": "9", "x": "new"}
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_revisits_match_brute_force_on_one_hot_url(spark):
    data = [(i, "http://hot/x", stamp(37 * i % 5000), "response" if i % 5 == 0 else "revisit", {"etag": str(i % 3)}) for i in range(600)]
    got = {r["record_id"]: r["base_id"] for r in rows(revisits.resolve_revisits(spark.createDataFrame(data, RECORDS)))}
    for i, _, at, kind, _ in data:
        if kind == "revisit":
            best = max(((a, k) for k, _, a, kd, _ in data if kd == "response" and a < at), default=(None, None))[1]
            assert got[i] == best


def test_ties_in_time_and_digests(spark):
    data = [(i, "http://t/x", stamp(i // 8), "response" if i % 4 == 0 else "revisit", {"etag": "1", "digest": str(i % 3)}) for i in range(300)]
    data += [(None, "http://n/x", stamp(0), "response", {"digest": "a"}), (900, "http://n/x", stamp(1), "revisit", {"digest": "a"}), (901, "http://n/x", stamp(1), "revisit", {"digest": "b"})]
    got = {r["record_id"]: r for r in rows(revisits.resolve_revisits(spark.createDataFrame(data, RECORDS)))}
    for i, _, at, kind, headers in data[:300]:
        if kind == "revisit":
            best = max(((a, k) for k, _, a, kd, _ in data[:300] if kd == "response" and a < at), default=None)
            assert got[i]["base_id"] == (best and best[1])
            assert got[i]["status"] == ("no_base" if best is None else "resolved" if best[1] % 3 == i % 3 else "mismatch")
    assert (got[900]["status"], got[901]["status"], got[900]["base_id"]) == ("resolved", "mismatch", None) and got[900]["merged"] == {"digest": "a"}


# ---------------------------------------------------------------- licences


def test_licenses_and_inheritance(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    data = [
        (1, "a/LICENSE", mit),
        (2, "a/b/c/x.py", "print(1)"),
        (3, "a/b/c/y.py", "# Licensed under the Apache License, Version 2.0\ncode"),
        (4, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (5, "a/z.py", "code about a license for fishing and many other unrelated things in the sea"),
        (6, "q/z.py", "code"),
        (7, "top.py", ""),
        (8, None, None),
        (2, "a/b/c/x.py", "print(1)"),
    ]
    df = spark.createDataFrame(data, "file_id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("line", F.lit(1))
    got = rows(licenses.scan_licenses(df))
    assert len(got) == 9
    assert {r["file_id"]: (r["license"], r["via"], r["from_dir"]) for r in got} == {
        1: ("MIT", "header", None), 2: ("GPL-3.0", "directory", "a/b"), 3: ("Apache-2.0", "header", None), 4: ("GPL-3.0", "header", None),
        5: ("MIT", "directory", "a"), 6: (None, "none", None), 7: (None, "none", None), 8: (None, "none", None),
    }
    assert licenses.scan_licenses(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_root_license_reaches_everything(spark):
    data = [(1, "LICENSE", "Released under the MIT License."), (2, "x.py", "code"), (3, "d/e/y.py", None)]
    got = {r["file_id"]: (r["license"], r["from_dir"]) for r in rows(licenses.scan_licenses(spark.createDataFrame(data, "file_id long, path string, text string")))}
    assert got == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", "")}


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_wrapped_headers_and_whole_licence_files(spark):
    bsd, mit = licenses._BSD, licenses._MIT
    numbered = bsd.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")
    data = [
        (1, "a/x.c", "/*\n" + wrapped(licenses._MPL, 72, " * ") + "\n */\nint main() { return 0; }"),
        (2, "a/y.py", "#!/usr/bin/env python\n# Copyright 2020 Some Body\n#\n" + wrapped(licenses._APACHE, 72, "# ") + "\n#\n" + wrapped(licenses._APACHE_REST, 72, "# ") + "\nimport os\nprint(os)"),
        (3, "b/LICENSE", "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + wrapped(mit, 72) + "\n\n" + wrapped(licenses._AS_IS, 72)),
        (4, "c/LICENSE.txt", "BSD 2-Clause License\n\nCopyright (c) 2021, Some Body\nAll rights reserved.\n\n" + wrapped(numbered, 72) + "\n\n" + wrapped(licenses._BSD_AS_IS, 72)),
        (5, "d/LICENSE", "BSD 3-Clause License\n\nCopyright (c) 2021, Some Body\nAll rights reserved.\n\n" + wrapped(numbered, 72) + "\n\n3. " + wrapped(licenses._BSD_NAME, 72) + "\n\n" + wrapped(licenses._BSD_AS_IS, 72)),
        (6, "e/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + "Everyone may copy this text.\n\n" + "Preamble words go on and on about freedom. " * 400),
        (7, "f/z.java", "// " + wrapped("This program " + licenses._GNU.format("Lesser General Public License", "2.1"), 60, "// ") + "\nclass Z {}"),
        (8, "g/LICENSE", "ISC License\n\nCopyright (c) 2021 Some Body\n\n" + wrapped(licenses._ISC, 72) + "\n\n" + wrapped(licenses._ISC_AS_IS, 72)),
        (9, "b/src/q.py", "print(1)"),
        (10, "h/big.txt", "some words without any cue " * 20000),
    ]
    got = {r["file_id"]: r["license"] for r in rows(licenses.scan_licenses(spark.createDataFrame(data, "file_id long, path string, text string")))}
    assert got == {1: "MPL-2.0", 2: "Apache-2.0", 3: "MIT", 4: "BSD-2-Clause", 5: "BSD-3-Clause", 6: "GPL-2.0", 7: "LGPL-2.1", 8: "ISC", 9: "MIT", 10: None}


def test_own_templates(spark):
    df = spark.createDataFrame([(1, "x.py", "# House license, ask the house"), (2, "y.py", "# Licensed under the Apache License, Version 2.0")], "file_id long, path string, text string")
    got = {r["file_id"]: r["license"] for r in rows(licenses.scan_licenses(df, templates=(("House", "House license, ask the house"),)))}
    assert got == {1: "House", 2: None}


def test_two_thousand_tokens_move_by_hash(spark):
    """The plan deals tokens out by a hash of fixed size, not by the line they are in."""
    lines = spark.createDataFrame([("license " * 5, 1)], "line string, n long").withColumn("key", F.unhex(F.md5("line")))
    plan = licenses.score_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(line#", plan)


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_warc_revisits", "op8_line_cleaning", "op10_chat_windows"])
def test_queries_match_their_sql(spark, sf_dir, name):
    import duckdb

    from folioflow.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, expected))
