"""Model expressions and the numerical plans over them: Laplace, optimisation, sampling, uncertainty."""
