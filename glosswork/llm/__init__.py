"""Training-data operators. Nothing outside this subpackage imports it but the entry module."""
