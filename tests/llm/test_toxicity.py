"""The lexicon automaton against edit distances, contexts, and accuracy on labels that were held out."""

import random
import zlib

import numpy as np

from editpulse.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_nearest(terms, token):
    found = [(d, t) for t in terms if (d := distance(t, token)) <= tx.edits_allowed(t)]
    return min(found, default=None)


def test_automaton_finds_the_nearest_term():
    rng = random.Random(1)
    terms = {"idiot", "idiots", "scum", "stupid", "stupidly", "worthless", "päthetisch", "du", "abab", "aaaaaaaa"}
    terms |= {"".join(rng.choices("abc", k=rng.randrange(1, 11))) for _ in range(60)}
    machine = tx.LexiconAutomaton(terms)
    tokens = {"", "x", "1diot", "idi0ts", "st*pid", "wrthles", "worthles", "wortless", "pathetisch", "scam", "s", "aaaaaa", "aaaaaaaaaa"}
    tokens |= {"".join(rng.choices("abcd", k=rng.randrange(12))) for _ in range(1500)}
    for term in sorted(terms):
        for _ in range(10):
            letters = list(term)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randrange(2)] = rng.choices(["", "z", "a"])
            tokens.add("".join(letters))
    for token in sorted(tokens):
        assert machine.nearest(token) == plain_nearest(terms, token), token
    assert tx.LexiconAutomaton([]).nearest("idiot") is None


def test_forgetting_states_changes_nothing(monkeypatch):
    monkeypatch.setattr(tx, "_KNOWN_STATES", 3)
    machine = tx.LexiconAutomaton(["worthless", "scum"])
    for _ in range(3):
        assert machine.nearest("worthles5") == (1, "worthless") and machine.nearest("scun") == (1, "scum") and machine.nearest("clean") is None


def test_quotation_and_abuse():
    def score(text, term):
        tokens = tx.tokens_of(text)
        return tx.quotation(tokens, next(k for k, t in enumerate(tokens) if term in t))

    assert score('he wrote "what an idiot you see" in the article', "idiot") == 1.0
    assert score("the word “idiot” is an insult", "idiot") == 1.0
    assert score("what an idiot that was", "idiot") == 0.0
    assert score("you are an idiot", "idiot") == 0.0
    assert score('he said "hello" and then idiot things', "idiot") == 0.5
    assert score('"a" idiot "b"', "idiot") == 0.0


def lexicon():
    counts = tx.Counted((4, 4, 4, 4, 4), (0, 0, 0, 0, 0))
    misspelt = {"scam": tx.Counted((0,) * 5, (20, 20, 20, 20, 20))}
    return tx.Lexicon({"idiot": counts, "scum": counts, "worthless": counts}, misspelt, tx.Counted((10,) * 5, (90,) * 5))


def test_features_by_context_and_spelling():
    scanner = tx.Scanner(lexicon())
    by = lambda text: dict(zip(tx.FEATURES, scanner.features(text), strict=True))
    assert all(v == 0 for v in by("nothing to see").values()) and all(v == 0 for v in by(None).values())
    plain, misspelt, quoted, harmless = by("an idiot here"), by("an 1diot! here"), by('she wrote "an idiot" there'), by("a scam here")
    assert plain["open_exact"] > 0 and plain["open_misspelt"] == plain["quoted"] == 0
    assert 0 < misspelt["open_misspelt"] < plain["open_exact"] and misspelt["open_exact"] == 0
    assert quoted["quoted"] > 0 and quoted["open_exact"] == quoted["terms"] == 0
    assert harmless["open_misspelt"] == 0  # texts of the other label use that word
    assert scanner.features("an idiot here", 2)[0] <= scanner.features("an idiot here")[0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    flipped = labels.withColumn("toxic", tx.F.when(tx.held_out(), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    rows = tx.score_toxicity(docs, flipped, ["doc_id", "lang"]).where("row.lang = 'en'").collect()  # held-out labels can't leak in
    scores = {r.row.doc_id: r.score for r in rows}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in scores]
    toxic = np.array([scores[r.doc_id] for r in held if r.toxic])
    clean = np.array([scores[r.doc_id] for r in held if not r.toxic])
    assert len(toxic) > 50 and len(clean) > 300
    assert np.mean(clean < tx.THRESHOLD) > 0.98
    assert np.mean(toxic >= tx.THRESHOLD) > 0.6


def test_misspelt_abuse_is_found_and_quotation_spared(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("aeiounrst", k=rng.randrange(3, 8))) for _ in range(n))
    abuse = ["worthless", "disgusting", "pathetic", "scumbag"]
    rows, labels = [], []
    for k in range(400):
        kind = k % 4
        term = rng.choice(abuse)
        text = [prose(30), f"{prose(20)} you {term} {prose(9)} {term}", f'{prose(12)} he wrote "{prose(2)} {term} {prose(1)}" {prose(12)}', prose(40)][kind]
        rows.append((k, text))
        labels.append((k, int(kind == 1)))
    tests = {
        1000: (f"{prose(20)} you worthles {prose(9)} d1sgusting {prose(4)}", True), 1001: (f"{prose(20)} you p@thetic {prose(9)} worthlesss", True),
        1002: (f'{prose(15)} he wrote "{prose(1)} worthless {prose(1)}" {prose(20)}', False), 1003: (prose(60), False), 1004: ("", False),
    }
    rows += [(k, t) for k, (t, _) in tests.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.row.doc_id: r for r in tx.score_toxicity(docs, marked).collect()}
    for k, (_, toxic) in tests.items():
        assert (got[k].score >= tx.THRESHOLD) == toxic, (k, got[k])
    assert [(h.term, h.edits) for h in got[1000].hits] == [("worthless", 1), ("disgusting", 1)]


def test_odd_rows(spark):
    rows = [(1, None, 9), (None, "", 9), (3, "a b", 9), (3, "a b", 9), (4, "x " * 30000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1, None), (None, 0, None), (9, None, None)], "doc_id long, toxic int, quality int")
    assert sorted(r.score for r in tx.score_toxicity(docs, labels).collect()) == [0.5] * 5
    both = spark.createDataFrame([(d, d % 2, 0) for d in range(5)] + [(3, 0, 0)], "doc_id long, toxic int, quality int")
    scores = [r.score for r in tx.score_toxicity(docs, both).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert tx.score_toxicity(docs.limit(0), labels.limit(0)).collect() == []
