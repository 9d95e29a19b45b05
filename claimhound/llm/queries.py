"""The registered queries of this package and the SQL that some are checked against."""

from __future__ import annotations

from claimhound.llm.chat import OP5_SQL, op5_relational_chat
from claimhound.llm.collocations import OP12_SQL, op12_prefix_free
from claimhound.llm.decontamination import op7_spaced_seeds
from claimhound.llm.html_cut import op10_minimum_cut
from claimhound.llm.jaccard import op6_heavy_light_join
from claimhound.llm.mixing import OP1_SQL, op1_poisson_mix
from claimhound.llm.neighbours import op9_small_world
from claimhound.llm.packing import op13_shortest_pack
from claimhound.llm.secrets import op8_guess_cost
from claimhound.llm.token_counts import op4_length_histogram
from claimhound.llm.token_files import op2_wavelet_tokens
from claimhound.llm.toxicity import op3_subword_toxicity
from claimhound.llm.turn_repair import op11_survivors

QUERIES = {
    f.__name__: f
    for f in (
        op1_poisson_mix,
        op2_wavelet_tokens,
        op3_subword_toxicity,
        op4_length_histogram,
        op5_relational_chat,
        op6_heavy_light_join,
        op7_spaced_seeds,
        op8_guess_cost,
        op9_small_world,
        op10_minimum_cut,
        op11_survivors,
        op12_prefix_free,
        op13_shortest_pack,
    )
}
ORACLE_SQL = {"op1_poisson_mix": OP1_SQL, "op5_relational_chat": OP5_SQL, "op12_prefix_free": OP12_SQL}
