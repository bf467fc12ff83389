"""The corpus operators' registered queries, with SQL where SQL can express the whole result."""

from __future__ import annotations

from tallywright.llm import fingerprint, language, lengths, minhash, mixing, neighbours, phrases, pieces, pii, quotes, repeats, toxicity, variants

QUERIES = {
    "op1_fingerprint": fingerprint.query,
    "op2_mix_sources": mixing.query,
    "op3_pieces": pieces.query,
    "op4_language": language.query,
    "op5_quotes": quotes.query,
    "op6_pii": pii.query,
    "op7_toxicity": toxicity.query,
    "op8_neighbours": neighbours.query,
    "op9_minhash": minhash.query,
    "op10_repeats": repeats.query,
    "op11_variants": variants.query,
    "op12_token_counts": lengths.query,
    "op13_phrases": phrases.query,
}
ORACLE: dict[str, str] = {
    "op2_mix_sources": mixing.SQL,
    "op5_quotes": quotes.SQL,
    "op8_neighbours": neighbours.SQL,
    "op9_minhash": minhash.SQL,
    "op11_variants": variants.SQL,
    "op13_phrases": phrases.SQL,
}
