"""The corpus queries and their SQL, by name."""

from . import bpe, compression_classifier, context_mixing, fingerprints, html_extract, packing, quality_rules, simhash, suffix_dedup, warc

QUERIES = {
    "op1_html": html_extract.op1_html,
    "op2_simhash": simhash.op2_simhash,
    "op4_packing": packing.op4_packing,
    "op5_warc": warc.op5_warc,
    "op6_quality": compression_classifier.op6_quality,
    "op8_context_mixing": context_mixing.op8_context_mixing,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_bpe": bpe.op10_bpe,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op7_fingerprints": fingerprints.op7_fingerprints,
}
ORACLES = {"op5_warc": warc.oracle(), "op3_quality_rules": quality_rules.oracle()}
