"""All named queries."""

from quillspark.plans import feature_queries, join_queries, report_queries, text_queries, variant_queries  # noqa: F401
from quillspark.plans.registry import ORACLES, QUERIES, widen

for _key, _columns in {
    "f1_tree_nodes": ("no", "pos"),
    "j18_keyword_groups": ("grp", "kw_no"),
    "j19_concept_prompts": ("n",),
    "j4_nearest_other_label": ("rank",),
    "j5_nearest_any": ("rank",),
    "j22_stratified_resample": ("draw_no",),
    "l5_mean_over_rounds": ("rank",),
    "l7_pruned_forms": ("rank",),
    "l8_relation_tags": ("n",),
    "m7_template_changes": ("rank",),
    "m13_equivalent_groups": ("idx",),
}.items():
    widen(_key, *_columns)

__all__ = ["ORACLES", "QUERIES"]
