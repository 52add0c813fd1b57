"""Every stage of the pipeline against a plain version, on real documents and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_line_dedup import brute as plain_lines
from test_near_dedup import brute as plain_groups

import corpus_pipeline

from netloom.llm import language

SF = "/root/testdata/sf0.001"


def words_of(text):
    return [w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w]


class PlainLanguage:
    """Counts of words and n-grams by language; log frequencies, the longest known n-grams for unknown words."""

    def __init__(self, rows):
        self.words, self.grams = defaultdict(Counter), {k: defaultdict(Counter) for k in (1, 2, 3, 4)}
        for text, lang in rows:
            for w in words_of(text):
                self.words[lang][w] += 1
                for k in self.grams:
                    for i in range(len(w) + 3 - k):
                        self.grams[k][lang][f"^{w}$"[i : i + k]] += 1
        self.languages = sorted(self.words)
        self.totals = {id(t): {lang: t[lang].total() for lang in t} for t in (self.words, *self.grams.values())}
        kept = lambda counts, most: Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]))
        for t, most in ((self.words, language.WORDS), *((g, language.GRAMS) for g in self.grams.values())):
            for lang in t:
                t[lang] = kept(t[lang], most)

    def logs(self, table, term):
        return np.array([math.log((table[lang][term] + 0.5) / (self.totals[id(table)][lang] + 1)) for lang in self.languages])

    def word(self, w):
        if any(w in self.words[lang] for lang in self.languages):
            return self.logs(self.words, w)
        for k in (4, 3, 2, 1):
            pieces = [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)]
            known = [self.logs(self.grams[k], p) for p in pieces if any(p in self.grams[k][lang] for lang in self.languages)]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.languages))

    def predict(self, text):
        words = words_of(text)
        if not words or not self.languages:
            return "und", 0.0
        logs = sum(self.word(w) for w in words) * min(len(words), 8) / len(words)
        odds = np.exp(logs - logs.max())
        return self.languages[int(odds.argmax())], float(odds.max() / odds.sum())


def table(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_stages_against_plain_versions(spark):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    source = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900_001, None, "en", "src0", 0), (900_002, "", "en", None, 0), (900_003, "12 34", None, "src0", 5), (None, "the house is there", None, "new", 0), (None, "the other house is not there", None, "new", 0)]
    first = source.orderBy("doc_id").limit(2).collect()
    odd += [tuple(first[0]), (first[0].doc_id, "the small house under that id stands there", "en", None, 0)]
    docs = source.union(spark.createDataFrame(odd, source.schema))
    own = "'k' as kept, 1 as rank, 's' as sid, 2 as th, 3.5D as score, 'l' as lang_pred, 4 as n_lines, 5 as n_deleted, 6 as n_runs, 7 as longest_run, 'w' as Size, 8 as extra0, 'x' as `a.b`"
    extra = docs.selectExpr("*", *own.split(", "))
    clashing = lambda df: {tuple(r) for r in df.select(*[f"`{c}`" for c in extra.columns[len(docs.columns) :]]).collect()}
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: corpus_pipeline.materialize(stages[name](spark, df, SF), name)
    before = [r.asDict() for r in extra.collect()]

    # language: the model learns from documents that aren't held out
    learn = [r for r in before if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["text"] is not None and r["lang"] is not None]
    model = PlainLanguage([(r["text"], r["lang"]) for r in learn])
    want = [r for r in before if (lambda lang, score: lang != "und" and score >= 0.5)(*model.predict(r["text"]))]
    now = step("language_id", extra)
    assert now.columns == extra.columns and clashing(now) == clashing(extra)
    rows = [r.asDict() for r in now.collect()]
    assert table(rows, "doc_id", "text", "lang", "kept") == table(want, "doc_id", "text", "lang", "kept") and len(rows) > 190

    # lines
    after = plain_lines([(r["doc_id"], r["text"]) for r in rows], 2, 5)
    want = [r | {"text": after[r["doc_id"], r["text"]][0]} for r in rows]
    now = step("line_dedup", now)
    assert now.columns == extra.columns and clashing(now) == clashing(extra)
    rows = [r.asDict() for r in now.collect()]
    assert table(rows, "doc_id", "text", "source", "rank") == table(want, "doc_id", "text", "source", "rank")
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    # near-duplicates: rows in the order of ids, null last; one of each group
    order = sorted({(r["doc_id"], r["text"]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    groups, _ = plain_groups([(i, t) for i, (_, t) in enumerate(order)])
    now = step("near_dedup", now)
    kept = [r.asDict() for r in now.collect()]
    names = {pair: i for i, pair in enumerate(order)}
    found = sorted(groups[names[r["doc_id"], r["text"]]] for r in kept)
    assert found == sorted(set(groups.values()))  # one for each group
    assert all(order[groups[names[r["doc_id"], r["text"]]]][0] == r["doc_id"] for r in kept)
    assert now.columns == extra.columns and {r["kept"] for r in kept} == {"k"}

    # mixing: targets from the rule; every pass takes words of the document, in order, none twice
    sizes, by_row = Counter(), {}
    for r in kept:
        sizes[r["source"]] += len(r["text"].split())
        by_row[r["doc_id"], r["source"]] = by_row.get((r["doc_id"], r["source"]), []) + [r["text"]]
    targets, open_, left = {}, {s for s in sizes}, sum(sizes.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted((s for s in sizes if s is not None)) + [None])}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            targets[s] = 3 * sizes[s] if full else unit * weight[s]
        left -= sum(targets[s] for s in full)
        open_ = open_ - full if full else set()
    now = step("mixing", now)
    assert now.columns == extra.columns and clashing(now) == clashing(extra)
    mixed = [r.asDict() for r in now.collect()]
    taken, of_doc = Counter(), Counter()
    for r in mixed:
        own, n = [Counter(t.split()) for t in by_row[r["doc_id"], r["source"]]], Counter(r["text"].split())
        assert any(not n - o for o in own) and n
        taken[r["source"]] += n.total()
        of_doc[r["doc_id"], r["source"]] += n.total()
    assert all(abs(taken[s] - targets[s]) <= 64 for s in sizes)
    assert all(n <= 3 * sum(len(t.split()) for t in by_row[k]) for k, n in of_doc.items())

    # tokens
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = stages["byte_bpe"](spark, now, SF).collect()
    got = sorted((r.n_tokens, hashlib.sha256(",".join(map(str, r.token_ids)).encode()).hexdigest()) for r in last)
    ids = [plain.encode_ordinary(r["text"]) for r in mixed]
    assert got == sorted((len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for x in ids)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_small_tables_are_not_broadcast(spark):
    """Line dedup and near-dedup join by merging at every size: on a small corpus the driver doesn't broadcast each table of each step."""
    from netloom.llm import components, line_dedup, minhash

    docs = spark.createDataFrame([(i, f"one line of words {i % 3}\nanother line here {i}") for i in range(6)], "doc_id long, text string")
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    edges = links.selectExpr("b AS u", "a AS v")
    for made in (line_dedup.dedup_lines(docs, lone_words=5), minhash.keep_one(docs), components._large_star(edges), components._small_star(edges)):
        plan = made._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
