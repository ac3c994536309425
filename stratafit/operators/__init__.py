"""Relational operators of the data model: reductions, scores, risk sets, likelihoods."""
