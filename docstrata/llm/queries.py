"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from docstrata.llm import crosstoken, decontam, htmlmain, langid, license, mixing, ordermin, pii, quality, simhash, toxicity, warc, whitening

QUERIES = {
    "op1_order_minhash": ordermin.query,
    "op2_warc_derivatives": warc.query,
    "op5_source_mixing": mixing.query,
    "op9_html_main_text": htmlmain.query,
    "op6_language_id": langid.query,
    "op4_license_scan": license.query,
    "op8_toxicity": toxicity.query,
    "op3_simhash": simhash.query,
    "op7_decontamination": decontam.query,
    "op10_pii": pii.query,
    "op11_quality_mil": quality.query,
    "op12_cross_tokenizer_alignment": crosstoken.query,
    "op13_embedding_whitening": whitening.query,
    "warc_files": warc.files_query,
}

ORACLES = {
    "op2_warc_derivatives": warc.SQL,
    "warc_files": warc.FILES_SQL,
    "op5_source_mixing": mixing.SQL,
    "op7_decontamination": decontam.SQL,
    "op10_pii": pii.SQL,
}
