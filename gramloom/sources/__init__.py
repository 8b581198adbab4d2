"""Readers and writers of matrix files, and the tables that the programs produce."""

from gramloom.sources.matrix_files import Matrix, read_delimited, read_epiq
from gramloom.sources.pedmap import read_map, read_ped, read_pedmap


def read_genotypes(spark, epiq=None, ped=None, map=None, delimiter=" ", sample_sep=""):
    """Genotypes from exactly one of: an .epiq file, or a .ped and a .map file."""
    if epiq and not (ped or map):
        return read_epiq(spark, epiq)
    if ped and map and not epiq:
        return read_pedmap(spark, map, ped, delimiter, sample_sep)
    raise ValueError("give either epiq, or both ped and map")


__all__ = ["Matrix", "read_epiq", "read_delimited", "read_pedmap", "read_ped", "read_map", "read_genotypes"]
