"""Arrays and the kernels that run on them."""
