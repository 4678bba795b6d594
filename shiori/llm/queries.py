"""The named queries of the subpackage."""

from __future__ import annotations

from . import lookalike, mixing, neighbours, packing, spam, splitting, termcounts


def queries() -> dict:
    return {
        "p1_found": splitting.p1_found,
        "p1_pieces": splitting.p1_pieces,
        "p1_rejoined": splitting.p1_rejoined,
        "p2_found": lookalike.p2_found,
        "p2_classes": lookalike.p2_classes,
        "p2_forms": lookalike.p2_forms,
        "p3_found": termcounts.p3_found,
        "p3_terms": termcounts.p3_terms,
        "p5_found": neighbours.p5_found,
        "p5_neighbours": neighbours.p5_neighbours,
        "p7_containers": packing.p7_containers,
        "p7_fill": packing.p7_fill,
        "p7_conserved": packing.p7_conserved,
        "p8_mix": mixing.p8_mix,
        "p8_shares": mixing.p8_shares,
        "p8_caps": mixing.p8_caps,
        "p9_found": spam.p9_found,
        "p9_pages": spam.p9_pages,
    }
