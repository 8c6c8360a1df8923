"""Column functions: normalisation, checksums, canonical forms, masks and tokens. All are Catalyst expressions."""
