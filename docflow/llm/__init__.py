"""Operations that prepare training data: rules, scores, near copies, masking, packing, search and encoding."""
