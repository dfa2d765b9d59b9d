"""Collocations, resampling and chat formatting against plain Python and SQL on small tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute_texts as B  # noqa: E402

from paneleffects.llm import chat, collocations, resampling  # noqa: E402
from paneleffects.llm.features import ALNUM, string_hashes, tokens_of  # noqa: E402


def check_sql(got, sql, **tables):
    con = duckdb.connect()
    for name, (rows, kinds) in tables.items():
        con.sql(f"CREATE TABLE {name} ({kinds})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    rel = con.sql(sql)
    order = [rel.columns.index(c) for c in got.columns]
    want = sorted((tuple(r[k] for k in order) for r in rel.fetchall()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    return want


def test_tokens():
    texts = ["Ab! c-D", None, "", "é9É x", "abc", "def", " ", "z"]
    t = tokens_of(pa.array(texts), ALNUM)
    plain = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(B.LOWER)) for x in texts]
    assert t.words.to_pylist() == [w for ws in plain for w in ws]
    assert t.counts.tolist() == [len(ws) for ws in plain]
    assert t.cut.tolist() == [k == 0 for ws in plain for k in range(len(ws))]
    assert len(tokens_of(pa.array([None, ""]), ALNUM).words) == 0 == len(tokens_of(pa.array([], pa.string()), ALNUM).words)
    assert string_hashes(pa.array(["", "a", "ab", "a"]))[1] == string_hashes(pa.array(["a"]))[0]


def phrases(rows, least, longest=5, contained=100, top=2000):
    """Collocations from plain dictionaries."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(B.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    out = []
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in cand.items():
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if not any(x == lang and len(q) > len(p) and inside(q) and 100 * b >= contained * a for (x, q), b in cand.items()):
            out.append((lang, " ".join(p), a, f[lang, p[:cut]], f[lang, p[cut:]], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, k + 1, *r[1:]) for k, r in enumerate(own[:top])]
    return ranked


def corpus(seed=11, docs=300):
    rng = random.Random(seed)
    vocab = B.vocabulary(rng, 40)
    fixed = [rng.sample(vocab, k) for k in (2, 3, 5, 7)]
    rows = []
    for _ in range(docs):
        w = []
        for _ in range(rng.randint(0, 30)):
            w += rng.choice(fixed) if rng.random() < 0.2 else [rng.choice(vocab) + rng.choice(["", "", "", ".", ",\t", "\n", "?x", "’"])]
        rows.append((rng.choice(["en", "de", "und", None]), " ".join(w)))
    return rows + [("en", None), (None, ""), ("en", " \t. "), ("xx", "once"), ("de", "hm " * 400), ("de", "A a " * 6000),
                   ("en", "Hm hm! hm\xa0x hm"), ("en", "Hm hm! hm\xa0x hm")]


def documents(spark, rows):
    """A table with further columns whose names the operator uses itself."""
    return spark.createDataFrame(
        [(None if i % 7 == 0 else i, t, lang, "w", 1, 2.0, 3) for i, (lang, t) in enumerate(rows)],
        "doc_id bigint, text string, lang string, phrase string, k int, score double, a int")


@pytest.mark.parametrize("least,contained,sample", [(100, 100, 8), (12, 100, 8), (5, 80, 2)])
def test_collocations(spark, least, contained, sample):
    rows = corpus()
    want = phrases(rows, least, contained=contained)
    assert len(want) > 5
    got = collocations.mine_collocations(documents(spark, rows), least, contained=contained, sample=sample)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_sql_top_and_empty(spark):
    rows = corpus()
    docs = documents(spark, rows)
    want = check_sql(
        collocations.mine_collocations(docs), collocations.SQL,
        documents=([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id BIGINT, text VARCHAR, lang VARCHAR"))
    assert want
    got = collocations.mine_collocations(docs, 12, top=3)
    assert sorted(map(tuple, got.collect())) == sorted(phrases(rows, 12, top=3))
    assert collocations.mine_collocations(docs.limit(0)).count() == 0
    assert collocations.mine_collocations(documents(spark, [("en", None), (None, "")])).count() == 0


def test_border_failures_are_expanded(spark):
    """A sample that proposes nothing still gives all phrases: the border finds them, expansions follow them."""
    rng = random.Random(4)
    rows = [("en", " ".join(["red", "green", "blue", "grey", "pink"] + [f"w{rng.randint(0, 5000)}"] * 2)) for _ in range(120)]
    docs = documents(spark, rows)
    frequent, passes = collocations.frequent_phrases(docs, sample=100_000)
    assert passes > 1
    found = {r.phrase: r.n for r in frequent.where("k > 1").collect()}
    assert found["red green blue grey pink"] == 120 and len(found) == 10
    whole, once = collocations.frequent_phrases(docs, sample=1)
    assert once == 1 and {r.phrase: r.n for r in whole.where("k > 1").collect()} == found


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = corpus(5, 80)
    want = sorted(phrases(rows, 12))
    monkeypatch.setattr(collocations, "MOST_BITS", 64)  # every phrase is a false positive
    got = collocations.mine_collocations(documents(spark, rows), 12)
    assert sorted(map(tuple, got.collect())) == want


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_007_199_254_740_993
    c = spark.createDataFrame([("en", "x y", 2, 8_000_000_000_001)], "lang string, phrase string, k int, a bigint")
    counts = spark.createDataFrame(
        [("en", "x", 9_000_000_000_007), ("en", "y", 8_100_000_000_011)], "lang string, phrase string, n bigint")
    totals = spark.createDataFrame([("en", big)], "lang string, n bigint")
    row = collocations._scored(c, counts, totals).collect()[0]
    assert row.score == 1000 * 8_000_000_000_001 * big // (9_000_000_000_007 * 8_100_000_000_011)


def resampled(rows, target, longest, buckets=10_000, percent=10, least=20, seed=2024):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(B.LOWER))
        return w, [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(x for _, text in docs for x in features(text)[1]) for docs in (rows, target))
    both = sum(s.values()), sum(t.values())
    gain = {x: math.floor(1000 * math.log((t[x] + 1) * (both[0] + buckets) / ((s[x] + 1) * (both[1] + buckets)))) for x in s}
    out = []
    for d, text in rows:
        w, f = features(text)
        weight = sum(gain[x] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    long = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    drawn = len(long) * percent // 100
    return [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(long)] + [(*r[:4], None) for r in out if r[4] < least]


def resampling_rows():
    rng = random.Random(12)
    vocab = B.vocabulary(rng, 500)
    weights = [1 / (i + 1) for i in range(500)]
    rows = [(d, ", ".join(rng.choices(vocab, weights, k=rng.randint(0, 60)))) for d in range(200)]
    rows += rows[3:9] + [(7, rows[90][1]), (None, rows[90][1])] + B.ODD
    target = [(i, " ".join(rng.choices(vocab[200:], k=30))) for i in range(15)] + [(None, None), (3, ""), (3, "!")]
    return rows, target


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 50), (3, 100)])
def test_resample(spark, longest, percent):
    rows, target = resampling_rows()
    wide = spark.createDataFrame([(d, t, 1, 2, 3.0) for d, t in rows], "doc_id bigint, text string, rank int, id int, score double")
    wanted = spark.createDataFrame(target, "item_id bigint, text string")
    got = resampling.resample(wide, wanted, longest, percent=percent)
    want = resampled(rows, target, longest, percent=percent)
    assert sum(r[4] is not None for r in want) > 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resample_sql_and_empty(spark):
    rows, target = resampling_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = spark.createDataFrame(target, "item_id bigint, text string")
    check_sql(
        resampling.resample(docs, wanted), resampling.SQL,
        documents=(rows, "doc_id BIGINT, text VARCHAR"), benchmark=(target, "item_id BIGINT, text VARCHAR"))
    assert resampling.resample(docs.limit(0), wanted).count() == 0
    none = resampling.resample(docs, wanted.limit(0))
    assert sorted(map(tuple, none.collect()), key=str) == sorted(resampled(rows, [], 1), key=str)


@pytest.mark.parametrize("words,pairs", [(0, 0), (5, 3), (1 << 16, 1 << 16)])
def test_the_head_changes_no_hash(spark, words, pairs):
    rows, _ = resampling_rows()
    head = resampling.find_head(spark.createDataFrame(rows, "doc_id bigint, text string").select("text"), 2, words, pairs)
    assert len(head.words) <= words and len(head.pairs) <= pairs
    assert (len(head.words) > 0) == (words > 0)
    text = pa.array([t for _, t in rows])
    t = tokens_of(text, ALNUM)
    plain = t.words.to_pylist()
    (one, _), (two, at), (three, at3) = resampling.run_hashes(t, head, 3)
    assert one.tolist() == [zlib.crc32(w.encode()) for w in plain]
    assert two.tolist() == [zlib.crc32(f"{plain[i]} {plain[i + 1]}".encode()) for i in at]
    assert three.tolist() == [zlib.crc32(" ".join(plain[i:i + 3]).encode()) for i in at3]
    assert len(two) == np.maximum(t.counts - 1, 0).sum()


CHATS = "conv_id bigint, turn bigint, role string, text string"


def chats():
    rng = random.Random(13)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[END]", "[ROLE]", "\\", "[\\INST]", "<", "[", "]", " ", "\n", "ok", "é", ""]
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 5, 9])):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool [/ROLE] x", "", None])
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))))
    rows += [(50, t, ["user", "assistant"][t % 2], f"long {t} [INST] </s>") for t in range(300)]
    rows += [(51, 3, "user", "gap"), (51, 9, "assistant", None), (51, 9, "assistant", None), (51, None, "user", "last")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (52, 0, "assistant", "x" * 200_000)]
    return rows


def test_chat_report(spark):
    rows = chats()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CHATS + ", part int, formatted string")
    want = check_sql(
        chat.chat_report(chat.with_hostile(df)), chat.SQL,
        conversations=(rows, "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR"))
    assert len(want) == 45
    small = chat.chat_report(df, window=4, lead=2)  # many windows
    assert sorted(map(tuple, small.collect()), key=str) == sorted((r for r in want if r[0] != -1), key=str)
    assert chat.chat_report(df.limit(0)).count() == 0


def test_spans_of_whole_and_windowed_conversations(spark):
    rows = [r for r in chats() if r[0] in (50, 7)]
    df = spark.createDataFrame(rows, CHATS)
    whole = {r.conv_id: r for r in chat.format_conversations(df, window=1000).collect()}
    assert all(r.single and r.rewrites == 0 for r in whole.values())
    for r in whole.values():
        assert [(t.start, t.start + t.length) for t in r.turns][1:] == [
            (a.start + a.length, b.start + b.length) for a, b in zip(r.turns, r.turns[1:], strict=False)]
        assert r.turns[0].start == 0 and r.turns[-1].start + r.turns[-1].length == len(r.formatted)
    parts = [r for r in chat.format_conversations(df, window=64).collect() if r.conv_id == 50]
    parts.sort(key=lambda r: r.part)
    assert len(parts) == 5 and not any(r.single for r in parts)
    assert "".join(r.formatted for r in parts) == whole[50].formatted
    at, spans = 0, []
    for r in parts:
        spans += [(t.turn, t.role, at + t.start, t.length) for t in r.turns]
        at += len(r.formatted)
    assert spans == [(t.turn, t.role, t.start, t.length) for t in whole[50].turns]


def templates():
    """Made here, so that workers need not import this file."""

    def forgetful(turns):
        """Keeps the thoughts of the last assistant turn only."""
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"<{r}>{t if i == last else re.sub('{.*?}', '', t)}</{r}>" for i, (r, t) in enumerate(turns))

    def numbered(turns):
        """Every turn says how many came before, so each depends on the whole history."""
        return "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(turns))

    return forgetful, numbered


def test_templates_that_rewrite_history_are_found(spark):
    forgetful, numbered = templates()
    plain = chat.ChatTemplate(forgetful)
    turns = [("user", "a"), ("assistant", "{hm} b"), ("user", "c"), ("assistant", "{so} d")]
    found = chat.locate_turns(plain, turns)
    kept = "<user>a</user><assistant>"
    assert found.rewrites == [(3, len(kept))] and found.text == forgetful(turns)
    assert found.spans[0] == (0, len("<user>a</user>"), None, None)
    assert found.spans[1] == found.spans[2] == (None,) * 4
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, "user", "x")], CHATS)
    assert {r.conv_id: r.rewrites for r in chat.format_conversations(df, plain).collect()} == {1: 1, 2: 0}
    long = spark.createDataFrame([(1, i, "user", "x") for i in range(30)], CHATS)
    with pytest.raises(Exception, match="looks back"):
        chat.format_conversations(long, chat.ChatTemplate(numbered), window=8).collect()
    assert chat.format_conversations(long, chat.ChatTemplate(numbered), window=64).collect()[0].rewrites == 0


def test_loss_text_is_found_behind_trimming_templates():
    trim = chat.ChatTemplate(lambda turns: "".join(f"<{r}> {t.strip()} <end>" for r, t in turns))
    found = chat.locate_turns(trim, [("user", "q"), ("assistant", "  <end> a  ")])
    start, length = found.spans[1][2:]
    assert found.text[start:start + length] == "<end> a"


def test_escaping_is_reversible():
    rng = random.Random(1)
    bits = ["<", "[", "\\", "/", "s>", "INST]", "ROLE]", "END]", "x", " "]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        e = chat.escape_control(t)
        assert chat.unescape_control(e) == t
        assert not re.search(r"[<\[](/?s>|/?(INST|SYS|ROLE|END)\])", e)


