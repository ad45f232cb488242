"""Functions: Column -> Column."""
