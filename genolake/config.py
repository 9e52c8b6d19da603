"""Run parameters from YAML, and chromosome tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from .operators.filters import DEFAULTS, Params

#: Chromosome names of the supported genomes and twice the autosomal length in Gbp.
GENOMES = {"hs37d5": ([str(k) for k in range(1, 23)], ["X", "Y"], 5.845001134), "hg38": ([f"chr{k}" for k in range(1, 23)], ["chrX", "chrY"], None), "mm10": ([f"chr{k}" for k in range(1, 20)], ["chrX", "chrY"], None)}
_NAMES = {"min_sc_alt": "min_sc_alt", "min_sc_dp": "min_sc_dp", "max_bulk_alt": "max_bulk_alt", "max_bulk_af": "max_bulk_af", "max_bulk_binom_prob": "max_bulk_binom_prob", "min_bulk_dp": "min_bulk_dp", "exclude_dbsnp": "exclude_dbsnp", "cigar_id_score_quantile_cutoff": "cigar_id_quantile", "cigar_hs_score_quantile_cutoff": "cigar_hs_quantile"}


@dataclass(frozen=True)
class Config:
    bulk_sample: str
    cells: tuple[str, ...]
    genome: str = "hs37d5"
    sex: str = "female"
    target_fdr: float = 0.01
    regions: tuple[str, ...] = ()
    params: dict[str, Params] = field(default_factory=lambda: dict(DEFAULTS))

    def haploid(self) -> list[str]:
        """Sex chromosomes of males."""
        return list(GENOMES[self.genome][1]) if self.sex == "male" else []

    def autosomes(self) -> list[str]:
        return list(GENOMES[self.genome][0])


def parse(text: str) -> Config:
    """The configuration of a YAML text; thresholds that it lacks have their defaults."""
    import yaml

    from dataclasses import replace

    y = yaml.safe_load(text)
    params = {}
    for muttype, p in DEFAULTS.items():
        own = {to: y[f"{muttype}_{name}"] for name, to in _NAMES.items() if f"{muttype}_{name}" in y}
        params[muttype] = replace(p, **own)
    return Config(y["bulk_sample"], tuple(y.get("sc_bams", {})), y.get("genome", "hs37d5"), y.get("sex", "female"), float(y.get("target_fdr", 0.01)), tuple(y.get("gatk_regions", ())), params)
