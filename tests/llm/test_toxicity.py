"""The label model of toxicity where insults are of two languages and some stems are in the lexicon by chance."""

import numpy as np

from millrace.llm.toxicity import fit_label_model


def test_classes_follow_the_labels_not_the_largest_split_of_votes():
    """Rows are clean, insulting by a lexicon's words, or insulting by an invented stem, whose voters go together; so do those of chance stems in clean rows."""
    n, r = 8000, np.random.default_rng(5)
    kind = r.choice(3, n, p=[0.9, 0.06, 0.04])
    v = np.zeros((n, 20), np.int8)
    v[:, :4] = (kind == 1)[:, None] & (r.random((n, 4)) < 0.6)
    v[:, 4:14] = (kind == 2)[:, None] & (r.random((n, 10)) < 0.8)
    chance, family = (kind == 0) & (r.random(n) < 0.03), r.integers(0, 2, n)
    v[:, 4:14] |= chance[:, None] & (np.arange(10) % 2 == family[:, None]) & (r.random((n, 10)) < 0.8)
    hits = v[:, :14].sum(1)
    v[:, 18] = np.where(hits >= 4, 1, np.where(hits == 0, -1, 0))
    v[:, 19] = np.where((hits == 0) & (r.random(n) < 0.7), -1, 0)
    patterns, which, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    which = which.ravel()
    model = fit_label_model(patterns, counts, (kind > 0).mean(), np.bincount(which, weights=kind > 0) / counts)
    toxic = model.posterior(patterns)[which] >= 0.5
    assert toxic[kind == 1].mean() > 0.8 and toxic[kind == 2].mean() > 0.8 and toxic[kind == 0].mean() < 0.03
