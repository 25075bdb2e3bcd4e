"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from . import decontaminate, exact_dedup, html_extract, license_scan, minhash, packing, passage_chains, quality, spelling, suffix_dedup, toxicity, warc, whitening

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_passage_chains": passage_chains.op3_passage_chains,
    "op4_packing": packing.op4_packing,
    "op5_minhash": minhash.op5_minhash,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality": quality.op9_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_warc": warc.op11_warc,
    "op12_whitening": whitening.op12_whitening,
    "op13_spelling": spelling.op13_spelling,
    "license_base_phrases": license_scan.license_base_phrases,
}

ORACLES = {"op10_exact_dedup": exact_dedup.ORACLE, "op5_minhash": minhash.ORACLE, "op8_suffix_dedup": suffix_dedup.ORACLE, "op11_warc": warc.ORACLE, "op13_spelling": spelling.ORACLE, "license_base_phrases": license_scan.ORACLE}
