"""terrane: spatial-diffusion and acoustic-feature analytics as Spark plans."""
