"""Training reads all of a line, as tagging does."""

import random

import numpy as np

from leadloom.llm import toxicity


def test_markers_after_a_chain_are_learnt():
    r = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    docs, labels = [], []
    for i in range(120):
        text = [r.choice(words) for _ in range(toxicity.CHAIN + 60)]
        if i % 3 == 0:
            text[toxicity.CHAIN + 20] = "grobian"
        docs.append(" ".join(text))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(docs, np.array(labels))
    assert model.weights.get("=grobian", 0) > 0
    bad, good = (model.score(t) for t in model.tag(["wax " * 300 + "grobian wex", "wax " * 300 + "wix wex"]))
    assert bad > 0.5 > good
