"""Registered queries of this subpackage, one per operator, and SQL where SQL can say the same."""

from . import bpe, brown, digest_runs, fim_frames, fingerprint, langid, licenses, maxsketch, mixing, pivots, ring, simhash_ball, warc

QUERIES = {
    "op1_pivot_permutations": pivots.query,
    "op2_kneser_ney_langid": langid.query,
    "op3_warc_revisits": warc.query,
    "op4_simhash": fingerprint.query,
    "op5_ring_shards": ring.query,
    "op6_brown_classes": brown.query,
    "op7_simhash_ball": simhash_ball.query,
    "op8_license_digests": licenses.query,
    "op9_prefix_bpe": bpe.query,
    "op10_entropy_mix": mixing.query,
    "op11_fim_frames": fim_frames.query,
    "op12_digest_runs": digest_runs.query,
    "op13_max_sketches": maxsketch.query,
}
ORACLES = {
    "op3_warc_revisits": warc.SQL,
    "op8_license_digests": licenses.SQL,
    "op11_fim_frames": fim_frames.SQL,
    "op12_digest_runs": digest_runs.SQL,
    "op13_max_sketches": maxsketch.SQL,
}
