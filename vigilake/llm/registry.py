"""The queries of this subpackage, gathered from its modules in the order of their numbers."""

from vigilake.llm import ball_tree, best_fit_packing, decontaminate, html_extract, jaccard_join, line_dedup, media_columns, merkle_manifest, minhash_dedup, quality_lm, suffix_dedup, url_filter, warc

MODULES = (line_dedup, decontaminate, warc, best_fit_packing, jaccard_join, media_columns, url_filter, html_extract, quality_lm, suffix_dedup, merkle_manifest, ball_tree, minhash_dedup)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
