"""Cross-sectional and rolling column functions, and the factor language."""
