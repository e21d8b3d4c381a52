"""The queries of this subpackage and, where SQL can express them, their SQL."""

from callscope.llm import (
    class_lm,
    decontaminate,
    fim,
    html_extract,
    license_scan,
    line_dedup,
    neardup,
    packing,
    quality_rules,
    simhash,
    spelling,
    token_count,
    toxicity,
)

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_near_duplicates": neardup.query,
    "op3_toxicity": toxicity.query,
    "op4_line_dedup": line_dedup.query,
    "op5_class_lm": class_lm.query,
    "op6_quality_rules": quality_rules.query,
    "op7_token_count": token_count.query,
    "op8_html_extract": html_extract.query,
    "op9_license_scan": license_scan.query,
    "op10_packing": packing.query,
    "op11_spelling_variants": spelling.query,
    "op12_simhash": simhash.query,
    "op13_fill_in_middle": fim.query,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_near_duplicates": neardup.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
