"""Scalar functions: tokens, stems, quantisation."""
