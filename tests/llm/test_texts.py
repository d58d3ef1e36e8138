import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialspan.llm import knn_quality as Q
from dialspan.llm import pieces as V
from dialspan.llm import pii as A
from dialspan.llm import quotes as C
from dialspan.llm.queries import tokenizer_path

KEY = b"key of the tests"
PIECES = tokenizer_path("piece_bpe_32k.model")


def viterbi(vocabulary, scores, text):
    best, back = [0.0], [0]
    for e in range(1, len(text) + 1):
        found = []
        for z in range(min(vocabulary.longest, e), 0, -1):
            s = scores.get(text[e - z : e], vocabulary.unknown if z == 1 else None)
            if s is not None:
                found.append((best[e - z] + s, z))
        top = max(s for s, _ in found)
        best.append(top)
        back.append(next(z for s, z in found if s == top))
    return best[-1]


def test_pieces_are_the_best_and_exact():
    vocabulary = V.Vocabulary(PIECES)
    scores = {vocabulary.text[i]: s for i, s in zip(vocabulary.ids, vocabulary.scores, strict=True)}
    rng = random.Random(1)
    texts = ["", " ", "  two  spaces ", "line\nend\n", "tab\tand\u00a0more", "日本🦄 x", "naïve café", "x" * 300, "\x00\x7f"]
    texts += ["".join(rng.choice("abcdeth \n.é") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    for text, ids in zip(texts, vocabulary.encode(texts), strict=True):
        assert vocabulary.decode(ids) == text
        if text and all(f"{c}".isalpha() or c in " ." for c in text):
            written = f" {text}".replace(" ", V.SPACE)
            got = sum(scores[vocabulary.text[i]] for i in ids if i not in vocabulary.byte_of) + sum(vocabulary.unknown for c in written if c not in scores)
            assert got == pytest.approx(viterbi(vocabulary, scores, written))


def test_pieces_of_documents(docs, no_docs):
    rows = V.digests(docs, PIECES).collect()
    assert len(rows) == 10 and all(r.exact for r in rows)
    back = V.decode(V.encode(docs, PIECES), PIECES).collect()
    assert sorted(r.text for r in back) == sorted((r.text or "") for r in docs.collect())
    assert V.digests(no_docs, PIECES).count() == 0


def test_permutation_is_a_bijection():
    made = {A.permuted(f"{a}{b:02d}", KEY, "t") for a in "abcdefghij" for b in range(100)}
    assert len(made) == 1000 and all(x[0].isalpha() and x[1:].isdigit() for x in made)


def test_surrogates_keep_type_and_format():
    text = "Mail Bob.01@mail.example.com or BOB.01@MAIL.EXAMPLE.COM; +1 (643) 555-5742, +1&&& (643)*** 555-5742; 4111 1111 1111 1111; DE89 3704 0044 0532 0130 00; 10.1.2.3; Mrs. Anna Smith; Господин Иван Петров."
    made, n = A.replaced(text, KEY, {})
    assert n == 9
    found = A.mentions(made)
    assert [f[2] for f in found] == [m[2] for m in A.mentions(text)]
    assert found[0][3] == found[1][3] and found[2][3] == found[3][3]  # one entity stays one
    assert not {m[3] for m in A.mentions(text)} & {f[3] for f in found}
    card = next(f[3] for f in found if f[2] == "card")
    assert A.luhn(card) == 0 and made[made.index("+1&&&") : made.index("+1&&&") + 5] == "+1&&&"
    assert next(f[3] for f in found if f[2] == "name")[0] == "f" and found[-1][3].split()[1] in A.GIVEN["cyrillic", "m"]
    assert A.replaced("Version 3. 4.0. 2.0. of 2024-01-02, 12 items", KEY, {}) == ("Version 3. 4.0. 2.0. of 2024-01-02, 12 items", 0)


def test_neighbouring_entities():
    kinds = lambda t: [m[2] for m in A.mentions(t)]
    assert kinds("+1 (826) 555-4081 190.137.223.204") == ["phone", "ip"]
    assert kinds("+1 (706) 555-3138 4644348398010899 12") == ["phone", "card"]
    assert kinds("4111-1111-1111-1111 3782 822463 10005") == ["card", "card"]
    assert kinds("a" * 100_000) == kinds("7." * 50_000) == []


def test_collisions_are_drawn_again(spark, docs, no_docs):
    rows = [(i, f"Mr. {n}") for i, n in enumerate(f"Q{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12))]
    rows.append((1000, f"Mr. {A.surrogate('name', 'm Qaa', KEY).split()[1]}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in A.anonymise(df, KEY).collect()}
    assert len(set(out.values())) == len(rows)  # 145 names, 30 single family names
    assert not {r[1] for r in rows} & set(out.values())
    got = {r.doc_id: (r.text, r.n_replaced, r.lang) for r in A.anonymise(docs, KEY).collect()}
    assert got[3] == (None, 0, "x") and got[7][1] == 1 and "a.b@" not in got[7][0] and got[1][0].startswith("The cat")
    assert len(A.anonymise(docs, KEY).collect()) == 10 and A.anonymise(no_docs, KEY).count() == 0


def test_quality_learns_from_text(spark, docs, no_docs):
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice("the of and stone river light walked slowly under".split()) for _ in range(60))
    junk = lambda: " ".join(w + rng.choice(["***", "&&&"]) for w in prose().split()) if rng.random() < 0.5 else " ".join([rng.choice(["buy", "win"])] * 60)
    rows = [(i, prose() if i % 3 else junk(), int(i % 3 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int"))
    out = Q.judge(df.select("doc_id", "text"), labels).join(df, "doc_id").toPandas()
    held = out[out.held_out]
    assert 50 < len(held) < 150 and (held.predicted == held.quality).mean() > 0.97
    hidden = labels.where(~Q.held_out(F.col("doc_id")))
    again = Q.judge(df.select("doc_id", "text"), hidden).toPandas().sort_values("doc_id")
    assert np.allclose(again.score, out.sort_values("doc_id").score)
    odd = {r.doc_id: r.score for r in Q.judge(docs, labels).collect()}
    assert odd[3] == odd[4] == 0.0 and len(odd) == 9
    assert Q.judge(no_docs, labels).count() == 0 and Q.judge(docs, labels.limit(0)).where("score = 0.5").count() > 0


def test_quotes(spark):
    rows = [(1, 0, "Hello all.\nSecond line here."), (1, 1, "> Hello all.\n> second LINE, here\nMy answer."), (1, 2, "On Monday Ann wrote:\n>> Hello all.\n> My answer.\nNested reply."), (1, 3, "No quote."), (1, 4, "> never said\nhm"), (2, 0, None), (2, 1, "> Hello all.\nother place"), (None, 5, "> Hello all."), (1, 1, "> Hello all.\n> second LINE, here\nMy answer.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("depth", F.lit("clash"))
    out = C.ordered(df)
    got = {(r.conv_id, r.turn): (r.reply_to, r.matched, r.thread, r.depth, r.text) for r in out.collect()}
    assert out.count() == 9
    assert got[1, 1] == (0, 2, 0, 1, "My answer.") and got[1, 2] == (1, 1, 0, 2, "Nested reply.")
    assert got[1, 3] == (None, 0, 3, 0, "No quote.") and got[1, 4][0] is None and got[2, 1][0] is None and got[2, 0][4] == ""
    assert C.ordered(df.limit(0)).count() == 0


def test_quoted_passages(spark):
    """A passage belongs to the message that has it as a whole, wherever its lines break; a part of one by its lines."""
    rows = [
        (1, 0, "Yes.\n\nThe rest of it."), (1, 1, "Thank you.\n\nSee below."), (1, 2, "Yes.\nThank you.\nSee below."),
        (1, 3, "> Yes. Thank\n> you. See\n> below.\nBroken elsewhere."), (1, 4, "> Yes.\n> Thank you.\nA part."), (1, 5, "On Monday Ann wrote:\n> Thank you.\n>\n> See below.\nTwo."),
        (1, 6, "> On Monday Ann wrote:\n>> See below.\nAn announced quote alone."), (1, 7, "On Monday Ann wrote:\n> On Monday Ann wrote:"),
        (1, 8, "> Yes. Thank you.\n> See below.\n\n> Yes.\n> Thank you.\n> See below.\n\n> Yes. Thank you. See below.\nThrice."),
    ]
    got = {r.turn: (r.reply_to, r.matched) for r in C.ordered(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got[3] == (2, 3) and got[8] == (2, 3) and got[5] == (1, 2) and got[6] == (1, 1) and got[7] == (None, 0)
    assert got[4] == (1, 1)  # each line is another message's, of equals the later
    parts = C.passages(spark.createDataFrame(rows[3:4], "conv_id long, turn long, text string"), ["conv_id"]).collect()
    assert [(p.level, len(p.lines)) for p in parts] == [(1, 3), (0, 1)]


def test_quotes_are_found_again(spark):
    rng = random.Random(9)
    rows = [(c, t, "user", " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))) for c in range(5) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    quoted = C.with_quotes(df)
    got = {(r.conv_id, r.turn): r for r in C.ordered(quoted).collect()}
    assert all(got[c, t].reply_to == (t - 1 if t else None) and got[c, t].depth == t and got[c, t].text == x for c, t, _, x in rows)
