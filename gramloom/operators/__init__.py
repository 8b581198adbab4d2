"""DataFrame operators: matrix reshaping, alleles, terms, Gram sums, OLS, scans."""
