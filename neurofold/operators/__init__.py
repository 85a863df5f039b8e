"""Image-neighbourhood, trace, join and motion operators."""
