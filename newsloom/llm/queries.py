"""Queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from newsloom.llm.boilerplate import p5_found
from newsloom.llm.language import p7_found, p7_languages
from newsloom.llm.leak import P9_FOUND_SQL, p9_edited, p9_found
from newsloom.llm.lines import P4_FOUND_SQL, p4_clean, p4_found
from newsloom.llm.lookalike import p3_canonical, p3_found
from newsloom.llm.packing import P8_TEXTS_SQL, p8_checks, p8_pack, p8_texts, p8_usage
from newsloom.llm.residue import p2_found
from newsloom.llm.subjects import p10_composition, p10_found
from newsloom.llm.truncation import p1_found, p1_sources

QUERIES = {"p1_found": p1_found, "p1_sources": p1_sources, "p2_found": p2_found, "p5_found": p5_found, "p7_found": p7_found, "p7_languages": p7_languages, "p8_pack": p8_pack, "p8_usage": p8_usage, "p8_checks": p8_checks, "p8_texts": p8_texts, "p9_found": p9_found, "p9_edited": p9_edited, "p10_found": p10_found, "p10_composition": p10_composition, "p3_found": p3_found, "p3_canonical": p3_canonical, "p4_found": p4_found, "p4_clean": p4_clean}
ORACLES = {"p4_found": P4_FOUND_SQL, "p8_texts": P8_TEXTS_SQL, "p9_found": P9_FOUND_SQL}
