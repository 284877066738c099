"""The pipeline: every stage against plain Python on its own input, and on empty and awkward tables."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lorekeep.llm import bpe, pii, quality
from tests.llm.test_text_ops import AWKWARD, brute_bins, brute_classes, brute_spans

SF = "/root/testdata/sf0.001"
CLASHING = ["_id", "_hash", "_doc", "_text", "_row", "row", "node", "class", "key", "keys", "clean", "text_hash", "quality", "_lines", "a", "b", "vec"]


def brute_lines(rows):
    """Of (doc_id, text), the texts without the lines of windows that occurred before; without those that lose all."""
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        lines, gone = (text or "").split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if re.search(r"[^\s]", "".join(window), re.ASCII):
                if window in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(window)
        if not gone:
            out[i] = text
        elif len(gone) < len(lines):
            out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_every_stage_on_its_own_input(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = lambda d: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "pii", "best_fit_packing"]
    steps = [docs]
    for _, stage in P.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    assert all(s.columns == docs.columns for s in steps[:-1])
    first, good, lined, single, clean = map(texts, steps[:-1])

    judged = {r.doc_id: r.predicted for r in quality.assess(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good == {i: t for i, t in first.items() if judged[i]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not [i for i in good if labels.get(i) == 0]
    assert lined == brute_lines(good)
    assert set(single) == set(brute_classes(lined).values()) and all(single[i] == lined[i] for i in single)

    terms = {r.term: r.p for r in pii.disclosing(steps[3]).collect()}
    for i, t in single.items():
        want, at = "", 0
        spans = brute_spans(t or "")
        words = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W_]+(?:['\u2019-][^\W_]+)*", t or "") if m[0].lower() in terms]
        spans += [w for w in words if not any(x < w[2] and w[0] < y for x, _, y in spans)]
        for a, k, b in sorted(spans):
            if a >= at:
                word = t[a:b]
                name = "" if k == 4 and terms[word.lower()] >= pii.NAMES else "[NUMBER]" if k == 4 and word.isdigit() else "[NAME]" if k == 4 and word[:1].isupper() else "[TERM]" if k == 4 else f"[{pii.KINDS[k].upper()}]"
                want += t[at:a] + name
            at = max(at, b)
        assert clean[i] == (t if t is None else want + t[at:])

    library, sizes, places = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json")), defaultdict(int), defaultdict(list)
    for r in steps[-1].collect():
        sizes[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert sizes == {i: 1 + len(library.encode(t or "", add_special_tokens=False).ids) for i, t in clean.items()}
    for rows in places.values():
        ends = np.cumsum([n for _, n in sorted(rows)])
        assert [o for o, _ in sorted(rows)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(places) == brute_bins([n for rows in places.values() for _, n in rows], 2048)
    assert sorted(map(str, P.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(str, steps[-1].drop("sequence_id", "offset").collect()))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(AWKWARD)] + [(None, "no id", None, None, 5), (None, None, None, None, None), (5, "same text here", "en", "s", 14)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit(n) for n, c in enumerate(CLASHING)}).cache()


def test_stages_take_empty_and_awkward_tables(spark, awkward):
    n = awkward.count()
    for name, stage in P.STAGES:
        empty = stage(spark, awkward.limit(0), SF)
        assert empty.collect() == [], name
        out = stage(spark, awkward, SF)
        rows = out.collect()
        if name == "best_fit_packing":
            assert sum(r.piece == 0 for r in rows) == n
            continue
        assert out.columns == awkward.columns and out.dtypes == awkward.dtypes, name
        if name == "pii":
            assert sorted(map(str, rows)) == sorted(map(str, awkward.collect()))
        if name == "line_dedup":
            assert len(rows) == n
        if name == "minhash_near_dedup":
            assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in rows if r.text and r.text.split()) == sorted((i is None, i or 0, t) for i, t in [*((k, t) for k, t in enumerate(AWKWARD) if t and t.split() and k != 6), (None, "no id")])
            assert len([r for r in rows if not (r.text or "").split()]) == 1
