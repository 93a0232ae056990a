"""Near copies: the links of fingerprints are among their candidates; what tasks leave in a worker."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from docaudit.llm import batches, simhash, tokens

from . import cases


def test_links_of_fingerprints_are_candidates(spark):
    """Without a MinHash key in common, copies of a long text with one changed word meet by their fingerprints alone."""
    words = [f"t{k * k % 4001}" for k in range(900)]
    rows = [(k, " ".join([*words[:k], "new", *words[k + 1 :]]) if k else " ".join(words)) for k in (0, 300, 600)] + [(7, " ".join(f"u{k * k % 3989}" for k in range(900)))]

    def apart(data, offsets):
        node, counts, keys = simhash.set_prints(data, offsets)
        return node, counts, keys ^ node[np.flatnonzero(counts)][:, None]

    found = {r.doc_id: r.component_id for r in simhash.duplicates(cases.documents(spark, rows), prints=apart).collect()}
    assert found == {0: 0, 300: 0, 600: 0, 7: 7}


def test_a_worker_drops_what_another_module_left():
    batches.begin("docaudit.llm.packing")
    tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    batches.begin("docaudit.llm.packing")
    assert tokens.encoder.cache_info().currsize == 1
    batches.begin("docaudit.llm.language")
    assert tokens.encoder.cache_info().currsize == 0
