"""Plans: the algebra, its builder and JSON form, and the lowering to DataFrames."""
