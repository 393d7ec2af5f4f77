"""Planning helpers: skew handling, shared storage, clause compilation."""
