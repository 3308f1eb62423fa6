"""Training-data operators: token counts, packing, language-model scores, toxicity, quality rules,
HTML extraction, line and document near-duplicates, WARC archives and benchmark decontamination.

Nothing outside this subpackage imports it.
"""
