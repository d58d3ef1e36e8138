"""Whole results of the operators that SQL can't express, held against plain Python."""

import hashlib
import random
import re
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from dialspan.llm import knn_quality as Q
from dialspan.llm import minhash as H
from dialspan.llm import queries
from dialspan.llm import quotes as C

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(values, form):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if form is None else struct.pack(form, v), seed)
    return signed(seed)


def fingerprint(text):
    """Bins by definition: the least value of each, empty ones from the donor that the bins' numbers choose."""
    words = [w for w in re.split(r"\s+", text.lower(), flags=re.ASCII) if w]
    codes = [hashed([w], None) for w in words]
    shingles = [hashed(codes[i : i + 5], "<q") for i in range(len(codes) - 4)] if len(codes) >= 5 else [hashed([" ".join(words)], None)] if words else []
    bins = {}
    for x in shingles:
        value = (x & (1 << 64) - 1) >> 9
        bins[x & 127] = min(value, bins.get(x & 127, 1 << 60))
    if not bins:
        return ""
    out = []
    for b in range(128):
        donor = b if b in bins else min(((hashed([b, j], "<i") & ~127) | j, j) for j in bins)[1]
        out.append(bins[donor] & 255)
    return bytes(out).hex()


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_by_definition(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    docs = [d for d in docs if d[1].isascii()] + [(10**6, ""), (10**6 + 1, "one"), (10**6 + 2, "A b c d e"), (10**6 + 3, "a B c d e f")]
    got = {r.doc_id: r for r in H.compare_neighbours(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    prints = [fingerprint(t) for _, t in docs]
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = fingerprint(edited)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[k], own), i
        assert r.near_edited == pytest.approx(likeness(prints[k], own)) and r.near_next == pytest.approx(likeness(prints[k], prints[(k + 1) % len(docs)]))


def plain_counts(text):
    raw = text.encode()
    out = np.zeros(Q.FEATURES, np.float32)
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        if a and b and c:
            out[(((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF) >> 20] += 1
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out[0] = sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(1, len(words))
    return out


def test_votes_by_definition(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        table = plain_counts(r.text or "")
        weighed = np.log1p(table.astype(np.float64)) * model.idf
        weighed[0] = 0
        weighed[0] = Q.REPEATS * np.sqrt(table[0]) * np.linalg.norm(weighed)
        latent = (weighed / max(np.linalg.norm(weighed), 1e-9)) @ model.axes
        near = sorted(((float(v @ latent) / max(np.linalg.norm(latent), 1e-9), label) for v, label in zip(model.vectors, model.labels, strict=True)), reverse=True)
        least = near[min(Q.NEIGHBOURS, len(near)) - 1][0] - 1e-7
        votes = [(max(s, 0.0) ** Q.SHARPNESS, label) for s, label in near if s >= least]
        want = sum(w * y for w, y in votes) / sum(w for w, _ in votes) if table.any() and sum(w for w, _ in votes) else 0.5 if table.any() else 0.0
        assert got[r.doc_id].score == pytest.approx(want, abs=2e-3), r.doc_id
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= Q.THRESHOLD)


def plain_replies(messages):
    """(conversation, turn) -> (reply_to, matched, thread, depth), message by message."""
    level = lambda x: (re.match(r"^(?:[ \t]*>)+", x) or [""])[0].count(">")
    norm = lambda x: "".join(c for c in re.sub(r"^(?:[ \t]*>)+", "", x).lower() if c.isalnum())
    announces = lambda x: re.match(C.ATTRIBUTION, x)
    def runs(text):
        found, last = [], None
        for x in (text or "").split("\n"):
            words = "" if announces(x) else norm(x)
            if words and last == level(x):
                found[-1][1].append(words)
            elif words:
                found.append((level(x), [words]))
            last = level(x) if words else None
        return found
    wholes, single, out = {}, {}, {}
    for c, t, text in messages:
        for n, lines in runs(text):
            if n == 0:
                wholes[c, "".join(lines)] = min(t, wholes.get((c, "".join(lines)), t))
                for words in lines:
                    single[c, words] = min(t, single.get((c, words), t))
    for c, t, text in messages:
        votes, rest, most = {}, set(), {}
        for n, lines in [(n, lines) for n, lines in runs(text) if n]:
            if wholes.get((c, "".join(lines)), t) < t:
                most[n, "".join(lines)] = max(len(lines), most.get((n, "".join(lines)), 0))
            else:
                rest |= {(n, words) for words in lines}
        for (n, whole), many in most.items():
            votes[n, wholes[c, whole]] = votes.get((n, wholes[c, whole]), 0) + many
        for n, words in rest:
            origin = single.get((c, words), t)
            if origin < t:
                votes[n, origin] = votes.get((n, origin), 0) + 1
        if votes:
            (n, origin), many = max(votes.items(), key=lambda v: (-v[0][0], v[1], v[0][1]))
            out[c, t] = (origin, many)
    def root(c, t):
        return (t, 0) if (c, t) not in out else (lambda r: (r[0], r[1] + 1))(root(c, out[c, t][0]))
    return {(c, t): (*out.get((c, t), (None, 0)), *root(c, t)) for c, t, _ in messages}


def test_replies_by_definition(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("stone river light walk slow under green hill".split()) for _ in range(3)) for _ in range(25)]
    rows = []
    for c in range(12):
        lines = {}
        for t in range(12):
            own = [rng.choice(pool) for _ in range(rng.randrange(0, 4))]
            quoted = []
            for _ in range(rng.randrange(0, 3)):
                source = lines.get(rng.randrange(max(1, t)), [])
                quoted += ["> " * rng.choice([1, 1, 2]) + x.upper() for x in rng.sample(source, min(len(source), 2))]
            lines[t] = own
            rows.append((c, t, "\n".join(quoted + own)))
    rows.append((99, 0, None))
    rows.append((100, 0, "word " * 60_000 + "\nlast line"))
    rows.append((100, 1, "> last line\nyes"))
    got = {(r.conv_id, r.turn): (r.reply_to, r.matched, r.thread, r.depth) for r in C.ordered(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got == plain_replies(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frames = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    plain = lambda v: None if v is None or (not isinstance(v, str) and pd.isna(v)) else v if isinstance(v, str) else float(v)
    got, want = (sorted(map(repr, (tuple(plain(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False, name=None)))) for f in frames)
    assert got == want
