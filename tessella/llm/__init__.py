"""Operations of large training-data pipelines over documents and pages."""
