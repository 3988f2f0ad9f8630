"""Column functions of the domain, all built-in expressions."""

from .scalar import (
    cigar_mapped_length,
    guarded_ratio,
    info_map,
    mean_qscore,
    percent,
    read_name_parts,
    round_half_even,
    round_like_numpy,
    safe_int,
)

__all__ = ["cigar_mapped_length", "guarded_ratio", "info_map", "mean_qscore", "percent", "read_name_parts", "round_half_even", "round_like_numpy", "safe_int"]
